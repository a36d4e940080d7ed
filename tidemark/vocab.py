"""Closed vocabularies and thresholds of the measurement domain."""

from __future__ import annotations

# Vocabularies.
GRAINS = ("report_date", "install_date", "event_date", "cohort_date")
COHORT_AGES = (1, 7)
REVENUE_TYPES = ("iap", "ad", "total", "subscription")
COMPONENTS = ("iap", "ad")
PLATFORMS = ("ios", "android", "web", "unknown")
#: In this order: the first pattern that a lower-case platform name holds.
PLATFORM_PATTERNS = {"ios": r"(^|[^a-z])i(os|phone|pad|pod)", "android": "android", "web": "web|desktop|browser"}
AUTHORITATIVE = ("matched_exact", "matched_confident", "manually_verified")
HUMAN_DECIDED = ("manually_verified", "rejected")
OPERATIONAL_CONFIDENCE = 0.9
AVAILABILITY = ("available", "partial", "stale", "unavailable", "blocked")
FRESHNESS = ("fresh", "delayed", "stale", "error", "unknown", "not_supported", "not_applicable")
RETRYABLE_ERRORS = ("rate_limited", "timeout", "network", "provider_unavailable")

# Networks and their channels.
PROVIDER_CHANNELS = {"meta_ads": "paid_social", "tiktok_ads": "paid_social", "google_ads": "paid_search", "unity_ads": "paid_network", "applovin": "paid_network"}
MEDIA_SOURCE_PROVIDERS = {
    "facebook": "meta_ads", "facebook_ads": "meta_ads", "meta": "meta_ads", "meta_ads": "meta_ads", "tiktok": "tiktok_ads", "tiktok_ads": "tiktok_ads", "bytedance": "tiktok_ads",
    "google": "google_ads", "google_ads": "google_ads", "googleadwords_int": "google_ads", "adwords": "google_ads", "unity": "unity_ads", "unity_ads": "unity_ads", "applovin": "applovin", "applovin_int": "applovin",
}
MEDIA_SOURCE_SYNONYMS = {
    "facebook": "meta", "facebookads": "meta", "facebookinstallads": "meta", "meta": "meta", "metaads": "meta", "googleadwords": "google", "googleadwordsint": "google", "googleads": "google", "adwords": "google",
    "tiktokads": "tiktok", "tiktokglobal": "tiktok", "bytedanceglobalint": "tiktok", "unityads": "unity", "applovinint": "applovin", "organic": "organic",
}

# The levels at which a pair of providers (attribution, marketing) publishes remote ids, in the order in which they are tried.
REMOTE_LEVELS = {("tenjin", "meta_ads"): ("ad_group", "campaign")}
REMOTE_DEFAULT = ("campaign",)

# Expected freshness of each stream in minutes.
EXPECTED_FRESHNESS = {"marketing": 180, "structure": 720, "attribution": 240, "revenue": 480}

# Smallest denominators of ratio metrics.
MIN_IMPRESSIONS, MIN_CLICKS, MIN_INSTALLS = 1000, 50, 25

# Anomaly rules.
BASELINE_DAYS, BASELINE_POINTS = 14, 7
ROBUST_Z, RELATIVE_DEVIATION, MAD_TO_SIGMA = 3.5, 0.3, 1.4826
ABSOLUTE_FLOOR = 20.0

# Findings about labels, not days; what freshness is worth in a score.
LABEL_CHECKS = ("attribution.missing_campaign_id", "marketing.missing_campaign_id")
FRESHNESS_SCORE = {"fresh": 1.0, "delayed": 0.7, "unknown": 0.6, "stale": 0.4, "error": 0.4}

# Floors of a reading.
MIN_SPEND, MIN_MATURE_DAYS = 50, 3

# Pacing, trend and target bands.
UNDER_PACE, OVER_PACE = 0.5, 1.25
HALF_DAYS, MATERIAL_CHANGE = 7, 20.0
TARGET_BAND = 0.15
COVERAGE_FLOOR, AMBIGUOUS_CEILING = 80.0, 10.0
