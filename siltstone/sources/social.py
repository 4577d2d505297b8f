"""Social posts of three platforms brought to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Where each platform keeps what; the first non-empty text wins.
TEXT_FIELDS = {
    "linkedin": {"id": ["id", "urn"], "content": ["text", "commentary"]},
    "reddit": {"id": ["id"], "content": ["selftext", "title"]},
    "x": {"id": ["id"], "content": ["text"]},
}
METRIC_FIELDS = {
    "linkedin": {"likes": "likes", "shares": "shares", "comments": "comments", "impressions": "impressions"},
    "reddit": {"likes": "ups", "shares": "num_crossposts", "comments": "num_comments", "impressions": "view_count"},
    "x": {
        "likes": "like_count",
        "shares": "retweet_count",
        "comments": "reply_count",
        "impressions": "impression_count",
    },
}
FIELDS = [
    "id", "urn", "text", "commentary", "media", "metrics", "selftext", "title", "url", "ups", "num_crossposts",
    "num_comments", "view_count", "public_metrics",
]
METRICS = ["likes", "shares", "comments", "impressions"]
PLATFORMS = list(TEXT_FIELDS)


def normalize(posts: DataFrame, platform: str = "platform", payload: str = "payload") -> DataFrame:
    """(platform, external_id, content, media_urls, metrics, raw) of posts given as JSON text.

    Posts of other platforms are left out here; ``rejects`` returns them.
    """
    name = F.lower(platform)
    # Long payloads are parsed twice at most: once for the envelope, once for what "data" holds.
    outer = posts.filter(name.isin(PLATFORMS)).select(
        name.alias("platform"), F.col(payload).alias("raw"), F.from_json(payload, _fields(["data", *FIELDS])).alias("o")
    )
    wrapped = (F.col("platform") != "linkedin") & F.col("o.data").isNotNull()
    inner = outer.withColumn("i", F.when(wrapped, F.from_json("o.data", _fields(FIELDS))).otherwise(F.col("o").dropFields("data")))
    inner = inner.withColumn("_source", F.when(wrapped, F.col("o.data")).otherwise(F.col("raw")))
    stats = (
        F.when(F.col("platform") == "linkedin", F.col("o.metrics"))
        .when(F.col("platform") == "x", F.coalesce(_filled("public_metrics"), F.col("o.metrics")))
    )
    names = sorted({f for fields in METRIC_FIELDS.values() for f in fields.values()} | set(METRICS))
    parsed = inner.withColumn("_stats", stats).withColumn("s", F.from_json("_stats", _fields(names)))
    # Only a missing field falls back to the plain name; one that is null counts 0.
    parsed = parsed.withColumn("_keys", F.when(F.col("platform") == "x", F.json_object_keys("_stats")))

    def metric(m: str) -> Column:
        x = METRIC_FIELDS["x"][m]
        given = F.coalesce(F.array_contains("_keys", x), F.lit(False))
        text = _per_platform(
            {
                "linkedin": F.col(f"s.{METRIC_FIELDS['linkedin'][m]}"),
                "reddit": F.col(f"i.{METRIC_FIELDS['reddit'][m]}"),
                "x": F.when(given, F.col(f"s.{x}")).otherwise(F.col(f"s.{m}")),
            }
        )
        return F.coalesce(_whole(text), F.lit(0)).cast("long").alias(m)

    def text(part: str) -> Column:
        first = {p: F.coalesce(*[_filled(f) for f in fields[part]]) for p, fields in TEXT_FIELDS.items()}
        return F.coalesce(_per_platform(first), F.lit("")).alias(part)

    # An id is taken as it stands, a zero too; where two fields can hold it the first that says something counts.
    ids = {"linkedin": F.coalesce(_filled("id"), F.col("i.urn")), "reddit": F.col("i.id"), "x": F.col("i.id")}
    nothing = F.array().cast("array<string>")
    listed = F.from_json("o.media", "array<struct<url: string>>")
    urls = F.filter(F.transform(listed, lambda e: e["url"]), lambda u: u.isNotNull() & (u != ""))
    media = {"linkedin": urls, "reddit": F.array_compact(F.array(_filled("url"))), "x": nothing}
    return parsed.select(
        "platform",
        F.coalesce(_per_platform(ids), F.lit("")).alias("external_id"),
        text("content"),
        F.coalesce(_per_platform(media), nothing).alias("media_urls"),
        F.struct(*[metric(m) for m in METRICS]).alias("metrics"),
        "raw",
    )


def _fields(names: list[str]) -> str:
    """A schema that takes each field as text; objects and lists keep their JSON text."""
    return ", ".join(f"{n} string" for n in names)


def _per_platform(values: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.col("platform") == p, v) for p, v in values.items()])


def rejects(posts: DataFrame, platform: str = "platform") -> DataFrame:
    """Posts of a platform there is no rule for, NULL included."""
    return posts.filter(~F.coalesce(F.lower(platform).isin(PLATFORMS), F.lit(False)))


def _filled(name: str) -> Column:
    """A field of the post as text, or NULL where it is missing, an empty text, or zero, false, {} or [] as such.

    Texts like "0" or "false" are kept; only for these few is the JSON looked at again.
    """
    v = F.col(f"i.{name}")
    field = F.try_variant_get(F.try_parse_json("_source"), f"$.{name}", "variant")
    is_text = F.coalesce(F.schema_of_variant(field) == "STRING", F.lit(False))
    empty = F.when(v.isin("0", "0.0", "-0", "false", "{}", "[]"), ~is_text).otherwise(v == "")
    return F.when(~empty, v)


def _whole(text: Column) -> Column:
    """Whole number from number text, the fraction cut off."""
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
