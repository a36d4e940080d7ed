"""Column functions of the measurement domain: names, sources, platforms, dates, ratios and identities."""

from __future__ import annotations

import re
import unicodedata
import zoneinfo
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import vocab


def lookup(values: Mapping[str, object], key: Column) -> Column:
    """The value of a small fixed table, null where it has none."""
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key]


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


# Sources, channels and platforms.
def media_source(raw: Column) -> Column:
    """The form in which sources are compared: lower case without separators, known synonyms made one; empty is null."""
    bare = F.regexp_replace(F.lower(F.trim(raw)), r"[\s_-]+", "")
    return F.when(raw != "", F.coalesce(lookup(vocab.MEDIA_SOURCE_SYNONYMS, bare), bare))


def is_organic(raw: Column) -> Column:
    return F.coalesce(media_source(raw), F.lit("organic")) == "organic"


def provider_channel(provider: Column) -> Column:
    return F.coalesce(lookup(vocab.PROVIDER_CHANNELS, provider), F.lit("unknown"))


def media_channel(raw: Column) -> Column:
    """The channel of a raw source, by its normal form. Organic is a channel of its own; a source of no known network is unknown."""
    source = F.coalesce(media_source(raw), F.lit("organic"))
    return F.when(source == "organic", "organic").otherwise(provider_channel(lookup(vocab.MEDIA_SOURCE_PROVIDERS, source)))


def is_paid_channel(channel: Column) -> Column:
    return channel.isin(*sorted(set(vocab.PROVIDER_CHANNELS.values())))


def sources_of_channel(channel: str) -> list[str]:
    """The normal forms of sources that belong to a channel, for isin filters."""
    if channel == "organic":
        return ["organic"]
    return sorted(s for s, p in vocab.MEDIA_SOURCE_PROVIDERS.items() if vocab.PROVIDER_CHANNELS[p] == channel)


def platform(raw: Column) -> Column:
    bare = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    found = F.lit("unknown")
    for name, pattern in reversed(vocab.PLATFORM_PATTERNS.items()):
        found = F.when(bare.rlike(pattern), name).otherwise(found)
    return found


# Names.
_BRACKETS = r"\(([^()]+)\)"


def _plain_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKC", name).lower()).strip()


def _plain_keys(name: str) -> list[str]:
    """The key of a whole name, then those of embedded names, empty ones among them."""
    return [_plain_key(name), *(_plain_key(x) for x in re.findall(_BRACKETS, name))]


def _folded(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else _plain_keys(n))


def _ascii(name: Column) -> Column:
    return name.rlike(r"\A\p{ASCII}*\z")


def _ascii_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def all_keys(name: Column) -> Column:
    """Keys of the whole name and of each embedded one, in order; empty where nothing is left of it.

    Only names beyond ASCII go to Python (in Arrow batches), where compatibility forms are folded first; others stay here.
    """
    beyond = F.pandas_udf(_folded, "array<string>")(F.when(~_ascii(name), name))
    return F.when(_ascii(name), F.concat(F.array(_ascii_key(name)), F.transform(embedded_names(name), _ascii_key))).otherwise(beyond)


def name_key(name: Column) -> Column:
    """Lower-case letters a to z and digits with single spaces, compatibility forms folded; null when nothing is left."""
    return F.nullif(F.element_at(all_keys(name), 1), F.lit(""))


def embedded_names(name: Column) -> Column:
    """Names within innermost brackets, in order."""
    inner = F.transform(F.regexp_extract_all(name, F.lit(_BRACKETS), F.lit(1)), F.trim)
    return F.filter(inner, lambda x: x != "")


def name_keys(name: Column) -> Column:
    """The whole name's key, then those of embedded names, each once."""
    return F.array_distinct(F.filter(all_keys(name), lambda k: k != ""))


def near_names(a: Column, b: Column) -> Column:
    """Diagnostic likeness: one key starts with the first three quarters (8 letters at least) of the other."""
    stem = lambda k: F.substr(k, F.lit(1), F.greatest(F.lit(8), F.floor(F.length(k) * 0.75).cast("int")))
    return F.startswith(a, stem(b)) | F.startswith(b, stem(a))


# Numbers.
def number(raw: Column) -> Column:
    """A CSV number: thousands separators go, what can't be read is 0."""
    return F.coalesce(optional_number(raw), F.lit(0.0))


def optional_number(raw: Column) -> Column:
    return F.regexp_replace(F.trim(raw), ",", "").try_cast("double")


def ratio(numerator: Column, denominator: Column, minimum: float = 0) -> Column:
    """numerator / denominator; null without a positive denominator that reaches the minimum."""
    return F.when((denominator > 0) & (denominator >= minimum), numerator.cast("double") / denominator.cast("double"))


def rounded(value: Column, places: int = 6) -> Column:
    """Half up towards positive infinity."""
    return F.floor(value * 10**places + 0.5) / float(10**places)


def change_percent(now: Column, before: Column) -> Column:
    return F.when(before > 0, rounded((now - before) / before * 100, 4))


# Dates.
def iso_date(text: Column) -> Column:
    """A date written exactly yyyy-MM-dd, else null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def local_date(instant: Column, zone: Column | str) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def minutes_since(instant: Column, now: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(instant)) / 60


def chunks(first: Column, last: Column, days: int) -> Column:
    """Contiguous inclusive date ranges of so many days, the last one cut."""
    starts = F.when(first <= last, F.sequence(first, last, F.make_dt_interval(F.lit(days)))).otherwise(F.array().cast("array<date>"))
    return F.transform(starts, lambda s: F.struct(s.alias("from"), F.least(F.date_add(s, days - 1), last).alias("to")))


# Identities.
def dimension_hash(dimensions: Mapping[str, Column], optional: Mapping[str, Column] | None = None) -> Column:
    """SHA-256 of sorted key=value pairs; a null is empty, but a null optional dimension leaves its pair out."""
    required = {k: F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit(""))) for k, v in dimensions.items()}
    extra = {k: F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), v.cast("string"))) for k, v in (optional or {}).items()}
    pairs = required | extra
    return F.sha2(F.concat_ws("|", *(pairs[k] for k in sorted(pairs))), 256)


def country_code(raw: Column) -> Column:
    code = F.upper(F.trim(raw))
    return F.when(code.rlike("^[A-Z]{2}$"), code)


def first_present(*candidates: Column) -> Column:
    return F.coalesce(*map(blank_to_null, candidates))


# Freshness.
def freshness(supported: Column, failed: Column, minutes: Column, expected: Column, age_days: Column) -> Column:
    """State of a stream from its support, last error, minutes since the last success and age of its newest day."""
    return (
        F.when(~supported, "not_supported")
        .when(failed, "error")
        .when(minutes.isNull(), "unknown")
        .when(minutes > expected * 3, "stale")
        .when(age_days >= 3, "stale")
        .when(age_days == 2, "delayed")
        .when(minutes > expected, "delayed")
        .otherwise("fresh")
    )


#: From worst to best.
_WORST = {"error": 0, "stale": 1, "unknown": 2, "delayed": 3, "fresh": 4}


def worst_freshness(status: Column) -> Column:
    """The worst state of a group, as an aggregate; states that don't apply are passed over (all of them: null)."""
    return F.min_by(status, lookup(_WORST, status))


def worst_of(statuses: Column) -> Column:
    """The worst state of an array; states that don't apply are passed over (all of them: null)."""
    rank = F.array_min(F.array_compact(F.transform(statuses, lambda s: lookup(_WORST, s))))
    return F.element_at(F.array(*map(F.lit, _WORST)), rank + 1)


def pct(part: Column, whole: Column) -> Column:
    """Per cent to one place, half up; null unless the whole is positive."""
    return F.when(whole > 0, rounded(part / whole * 100, 1))


def stable_id(*parts: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the parts joined by bars; a null part is empty."""
    return F.substr(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256), F.lit(1), F.lit(32))


def inputs_hash(fields: Mapping[str, Column]) -> Column:
    """SHA-256 of the fields as one JSON object in their order, nulls written out."""
    return F.sha2(F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())), {"ignoreNullFields": "false"}).cast("binary"), 256)


def merged_set(a: Column, b: Column) -> Column:
    """Both lists' values, each once, in order; a null list is empty."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))


def reporting_window(now: Column, zone: Column, days: int = 7) -> Column:
    """(from, to): the last days up to today in the zone; a zone that isn't known counts as UTC."""
    known = F.coalesce(F.upper(zone).isin(*(z.upper() for z in zoneinfo.available_timezones())), F.lit(False))
    today = F.to_date(F.from_utc_timestamp(now, F.when(known, zone).otherwise("UTC")))
    return F.struct(F.date_sub(today, days - 1).alias("from"), today.alias("to"))


def key_window(key: Column) -> Column:
    """(from, to) of a window key written from..to; a part that is no date is null."""
    part = lambda n: F.try_to_date(F.split_part(key, F.lit(".."), F.lit(n)), "yyyy-MM-dd")
    return F.struct(part(1).alias("from"), part(2).alias("to"))


def covers(first: Column, last: Column, day: Column) -> Column:
    """Whether an interval holds the day; a null end is open."""
    return (first.isNull() | (first <= day)) & (last.isNull() | (last >= day))


def attribution_note(status: Column, confidence: Column, children: Column) -> Column:
    """What a campaign's best mapping lets a reader conclude from its attribution columns; null where there's nothing to add."""
    several = F.coalesce(children, F.lit(0)) > 1
    sure = F.coalesce(confidence, F.lit(0.0)) >= vocab.OPERATIONAL_CONFIDENCE
    return (
        F.when(status.isin(*vocab.AUTHORITATIVE), F.when(several, "several_children"))
        .when(status == "matched_fallback", F.when(~sure, "low_confidence").when(several, "embedded_name_several_children").otherwise("embedded_name"))
        .when(status.isin("ambiguous", "unmatched", "rejected"), status)
        .otherwise("not_computed")
    )
