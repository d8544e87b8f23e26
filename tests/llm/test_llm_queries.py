"""Every registered query of the operators on the smallest tables: its columns and types, and its rows against SQL, brute force or labels."""

import hashlib
import os

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from rolecorpus.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
COLUMNS = {
    "op1_suffix_array_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op2_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op3_pii_pseudonyms": "doc_id bigint, text string, n_email bigint, n_iban bigint, n_card bigint, n_ssn bigint, n_phone bigint, n_ip bigint, n_date bigint, n_secret bigint",
    "op4_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op5_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op6_html_extraction": "page_id bigint, url string, text string, n_chars bigint",
    "op7_line_dedup": "doc_id bigint, text string, lines_removed bigint, chunks_removed bigint",
    "op8_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op9_source_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op11_phrase_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_embedding_dedup": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op13_dataset_manifest": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op10_decontamination": "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint, containment double",
}


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def results(spark):
    return {name: query(spark, SF) for name, query in queries.queries().items()}


def test_columns_and_types(results):
    assert {k: ", ".join(f"{c} {t}" for c, t in df.dtypes) for k, df in results.items()} == COLUMNS


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(results, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    round_ = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    assert sorted(tuple(round_(r[c]) for c in names) for r in results[name].collect()) == sorted(tuple(map(round_, r)) for r in want.fetchall())


def test_substrings_equal_brute_force(results):
    seen, want = set(), {}
    for r in sorted(table("documents"), key=lambda r: r["doc_id"]):
        raw = (r["text"] or "").encode()
        windows = [raw[k : k + 50] for k in range(len(raw) - 49)]
        gone = np.zeros(len(raw), bool)
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + 50] = True
        seen.update(windows)
        spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
        want[r["doc_id"]] = (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in results["op1_suffix_array_dedup"].collect()} == want


def test_neighbours_against_brute_force(results):
    rows = [(r["vec_id"], np.asarray(r["embedding"], np.float64)) for r in table("embeddings") if r["embedding"] is not None]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = results["op2_nearest_neighbours"].toPandas()
    hits = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[k]
        score[k] = -2
        best = set(ids[np.lexsort((ids, -score))[:5]].tolist())
        own = got[got["query_id"] == ids[k]]
        assert own["rank"].tolist() == list(range(1, 6))
        hits, total = hits + len(best & set(own["vec_id"])), total + 5
    assert hits / total >= 0.9


def test_pseudonyms_link_and_invert(spark, results):
    from rolecorpus.llm import privacy

    back = privacy.pseudonymize(results["op3_pii_pseudonyms"].select("doc_id", "text"), queries.SAMPLE_KEY, back=True)
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    same = [r.text == texts[r.doc_id] for r in back.collect()]
    assert len(same) == len(texts) and np.mean(same) == 1


def test_languages_held_out(results):
    lang = {r["doc_id"]: (r["lang"], r["text"]) for r in table("documents")}
    got = results["op4_language_id"].collect()
    assert len(got) == len(lang) and all(0 <= r.score <= 1 for r in got)
    sure = [(r.lang_pred, lang[r.doc_id][0]) for r in got if r.held_out and lang[r.doc_id][0] and r.lang_pred != "und"]
    assert np.mean([a == b for a, b in sure]) > 0.9 and len(sure) > 20


def test_quality_held_out(results):
    label = {r["doc_id"]: r["quality"] for r in table("labels")}
    got = results["op5_quality_classifier"].collect()
    assert len(got) == len(table("documents")) and all(r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.score, label[r.doc_id]) for r in got if r.held_out and label.get(r.doc_id) is not None]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    if good and bad:
        assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.8


def test_extraction_lines_are_of_their_page(results):
    from rolecorpus.llm.extraction import page_lines

    pages = {r["page_id"]: r for r in table("pages")}
    got = results["op6_html_extraction"].collect()
    assert len(got) == len(pages)
    for r in got:
        lines = [x.text for x in page_lines(pages[r.page_id]["html"])]
        own = r.text.split("\n\n") if r.text else []
        it = iter(lines)
        assert all(x in it for x in own) and r.n_chars == len(r.text)  # in page order
    assert np.mean([bool(r.text) for r in got]) > 0.9


def test_repeated_units_stay_once(results):
    from rolecorpus.llm.line_dedup import chunk_lines

    texts = {r["doc_id"]: r["text"] or "" for r in table("documents")}
    units = lambda t: {t.encode()[lo:hi] for _, _, lo, hi, _ in chunk_lines(t)}
    before = set().union(*(units(t) for t in texts.values()))
    got = results["op7_line_dedup"].collect()
    assert len(got) == len(texts) and sum(r.lines_removed for r in got) > 0
    lines = {x for r in got for x in (r.text or "").split("\n")}
    assert {x for t in texts.values() for x in t.split("\n")} == lines | {""} or {x for u in before for x in u.decode().split("\n")} <= lines | {""}
