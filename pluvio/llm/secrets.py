"""Secret scan with corpus-wide ownership frequency (operator 4), DataFrame functions only.

Base spans come from three patterns. A fourth, wider pattern proposes candidates that only the corpus can judge: every
candidate value, as a hash, is counted over the distinct repositories and owners it occurs in. A value
that ``EXAMPLE_OWNERS`` owners share, or ``EXAMPLE_REPOSITORIES`` repositories of whichever owners, is a copied example;
one that a single owner has in fewer repositories looks live; the rest is shared. Live wide candidates
are added as ``owned`` spans; base spans always stay, with their verdict beside them.

A repository is a document and its owner the ``source`` unless told otherwise; rows without an owner count as
one owner of their own. Nulls and empty texts have no spans. Repeated rows (same id, same text) count as one
repository and get the same result each. Texts are scanned whole; positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.llm.common import fresh

_NAMES = "|".join(
    "".join(f"[{c.upper()}{c}]" for c in name) + tail
    for name, tail in (("password", ""), ("passwd", ""), ("secret", ""), ("token", ""), ("api", "_?[Kk][Ee][Yy]"))
)
ASSIGN = rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# Runs are taken whole, so asking for the least length at once drops the same matches.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
WIDE = r"[A-Za-z0-9+/_=-]{24,}"
KINDS = ("assign", "access", "hex", "owned")
# A value of so many owners, or in so many repositories, is a copied example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 20
# Private-use characters: the first marks the borders of matches, the second stands in for it in texts that
# have it; no pattern matches either, and both count one code point.
MARK, STAND_IN = "\ue000", "\ue001"


def matches(text: Column, pattern: str) -> Column:
    """(start, end, match) of all matches, leftmost first, none overlapping."""
    safe = F.translate(text, MARK, STAND_IN)
    parts = F.split(F.regexp_replace(safe, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    found = "array<struct<start:int,end:int,match:string>>"
    placed = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"), F.array().cast(found).alias("found")),
        lambda acc, part: F.struct(
            (acc["at"] + F.char_length(part)).alias("at"),
            (~acc["hit"]).alias("hit"),
            F.when(
                acc["hit"],
                F.concat(
                    acc["found"],
                    F.array(
                        F.struct(
                            acc["at"].alias("start"), (acc["at"] + F.char_length(part)).alias("end"), part.alias("match")
                        )
                    ),
                ),
            )
            .otherwise(acc["found"])
            .alias("found"),
        ),
    )
    return F.when(F.size(parts) > 1, placed["found"]).otherwise(F.array().cast(found))


def candidates(docs: DataFrame, id: str, owner: str, text: str) -> DataFrame:
    """(id, key, owner, kind, start, end, value): base spans and wide candidates; ``value`` is the secret's hash."""

    def spans(kind: str, pattern: str, value, keep=lambda m: F.lit(True)) -> Column:
        return F.transform(
            F.filter(matches(F.coalesce(F.col(text), F.lit("")), pattern), keep),
            lambda m: F.struct(
                F.lit(kind).alias("kind"),
                m["start"].alias("start"),
                m["end"].alias("end"),
                F.sha2(value(m["match"]).cast("binary"), 256).alias("value"),
            ),
        )

    def assigned(match: Column) -> Column:
        return F.regexp_extract(match, ASSIGN, 2)

    found = F.concat(
        spans("assign", ASSIGN, assigned, lambda m: F.length(assigned(m["match"])) >= 12),
        spans("access", ACCESS, lambda m: m),
        spans("hex", HEX, lambda m: m),
        spans("owned", WIDE, lambda m: m, lambda m: m["match"].rlike("[0-9]") & m["match"].rlike("[A-Za-z]")),
    )
    return docs.select(
        F.col(id).alias("id"), F.xxhash64(text).alias("key"), F.col(owner).alias("owner"), F.inline(found)
    ).distinct()


def ownership(found: DataFrame) -> DataFrame:
    """(value, repositories, owners, verdict) of every candidate value; each level is summed before it is shuffled."""
    per_owner = found.groupBy("value", "owner", "id", "key").agg(F.lit(1).alias("one")).groupBy("value", "owner")
    counted = per_owner.agg(F.count("*").alias("n")).groupBy("value")
    copied = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    return counted.agg(F.sum("n").alias("repositories"), F.count("*").alias("owners")).withColumn(
        "verdict", F.when(copied, "example").when(F.col("owners") == 1, "live").otherwise("shared")
    )


def find_secrets(docs: DataFrame, id: str = "doc_id", owner: str = "source", text: str = "text") -> DataFrame:
    """(id, key, kind, start, end, value, repositories, owners, verdict): base spans and those the corpus adds."""
    found = candidates(docs, id, owner, text)
    judged = found.drop("owner").distinct().join(ownership(found), "value")
    return judged.filter((F.col("kind") != "owned") | (F.col("verdict") == "live"))


def scan(docs: DataFrame, id: str = "doc_id", owner: str = "source", text: str = "text") -> DataFrame:
    """All rows of ``docs`` with ``secrets`` added: (start, rank, kind, end, verdict, owners, repositories), ordered."""
    key, secrets = fresh(docs, "key", "secrets")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct("start", rank.alias("rank"), "kind", "end", "verdict", "owners", "repositories")
    found = (
        find_secrets(docs, id, owner, text)
        .groupBy(F.col("id").alias("found.id"), F.col("key").alias("found.key"))
        .agg(F.array_sort(F.collect_list(span)).alias("found.spans"))
    )
    none = F.array().cast(found.schema["found.spans"].dataType)
    same = F.col(id).eqNullSafe(F.col("`found.id`")) & (F.col(key) == F.col("`found.key`"))
    return (
        docs.withColumn(key, F.xxhash64(text))
        .join(found, same, "left")
        .select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("`found.spans`", none).alias(secrets))
    )
