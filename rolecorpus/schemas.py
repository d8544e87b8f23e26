"""Explicit schemas of feeds; nothing is inferred from data."""

GREENHOUSE = "struct<jobs: array<struct<id: bigint, title: string, absolute_url: string, location: struct<name: string>, updated_at: string, first_published: string, company_name: string, content: string>>>"
LEVER = (
    "array<struct<id: string, text: string, hostedUrl: string, descriptionPlain: string, description: string, additional: string, categories: struct<location: string, commitment: string, team: string>, createdAt: bigint>>"
)
ASHBY = (
    "struct<jobs: array<struct<id: string, title: string, jobUrl: string, applyUrl: string, descriptionHtml: string, descriptionPlain: string, location: string, isRemote: boolean, publishedAt: string, "
    "compensation: struct<compensationTierSummary: string, summaryComponents: array<struct<summary: string, currencyCode: string, min: double, max: double>>>>>, jobBoard: struct<name: string>>"
)
_PLACE = "struct<city: string, region: string, country: string, remote: boolean, fullLocation: string>"
SMARTRECRUITERS_LIST = f"struct<content: array<struct<id: string, name: string, company: struct<name: string>, releasedDate: string, location: {_PLACE}, ref: string>>>"
_TEXT = "struct<text: string>"
SMARTRECRUITERS_DETAIL = (
    f"struct<id: string, applyUrl: string, postingUrl: string, releasedDate: string, company: struct<name: string>, location: {_PLACE}, "
    f"jobAd: struct<sections: struct<companyDescription: {_TEXT}, jobDescription: {_TEXT}, qualifications: {_TEXT}, additionalInformation: {_TEXT}>>>"
)
WORKDAY_LIST = "struct<jobPostings: array<struct<title: string, externalPath: string, locationsText: string, postedOn: string, bulletFields: array<string>>>>"
WORKDAY_DETAIL = "struct<title: string, jobDescription: string, location: string, jobReqId: string, externalUrl: string>"
ADZUNA = (
    "struct<results: array<struct<id: string, title: string, company: struct<display_name: string>, location: struct<area: array<string>, display_name: string>, salary_min: double, salary_max: double, "
    "salary_is_predicted: int, redirect_url: string, description: string, created: string>>>"
)
#: The common columns that every feed gives.
POSTING_COLUMNS = ["url", "title", "company", "location_raw", "location", "is_remote", "description", "published_at", "source", "salary_min_usd", "salary_max_usd", "salary_raw", "dedup_key"]
EVENT_STREAM = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
