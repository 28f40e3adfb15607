"""Secret scans: patterned and random-looking candidates, told apart by how many owners hold the same value."""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ambientspark.llm.common import per_batch, staged

#: Patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 8, "access": 16}
#: Random-looking runs: so long, of letters and digits, with so many bits a character.
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LEAST_BITS = 3.2
#: A value held by at least so many owners is a widely copied example; by one, it belongs to that owner.
EXAMPLE_OWNERS = 3


def bits(value: str) -> float:
    """Shannon entropy of the characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) in code points; random ones only where no base span lies."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [("assign", *m.span(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    covered = sorted(x[1:3] for x in found)
    for m in RANDOM.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and bits(value) >= LEAST_BITS:
            if all(b <= m.start() or m.end() <= a for a, b in covered):
                found.append(("random", *m.span(), value))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def secret_candidates(docs: DataFrame, repository: str = "repository", owner: str = "owner") -> DataFrame:
    """doc_id, repository, owner and candidates (kind, start, end, value hash) of every row of docs.

    A null text is empty; rows with null or repeated ids, repositories or owners are kept. Values leave the task as 64-bit hashes only.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64())]))

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": a, "end": b, "hash": xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass")) - (1 << 63)} for k, a, b, v in candidates(t or "")]
                 for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "repository", "owner")), pa.array(found, kind)],
                                          names=["doc_id", "repository", "owner", "candidates"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(repository).cast("string").alias("repository"),
                       F.col(owner).cast("string").alias("owner"), F.col("text").alias("text"))
    return per_batch(rows, step, "doc_id long, repository string, owner string, candidates array<struct<kind: string, start: bigint, end: bigint, hash: bigint>>")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_documents, n_repositories, n_owners over the whole corpus; null repositories and owners count as one each.

    Documents are first counted by (hash, repository, owner) in each task, so a value that very many documents copy is a few rows.
    """
    flat = found.select(F.explode(F.array_distinct("candidates.hash")).alias("hash"), F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("owner", F.lit("")).alias("owner"))
    held = flat.groupBy("hash", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    return held.groupBy("hash").agg(
        F.sum("n").alias("n_documents"), F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners"))


def secret_spans(docs: DataFrame, repository: str = "repository", owner: str = "owner", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """doc_id and spans of every row of docs: each candidate with its value's owners and verdict.

    Verdict: example (at least `example_owners` owners), shared (several), reused (one owner, several repositories: the one worth most) or live
    (one owner, one repository). Base kinds always are spans; random-looking values are spans only if one owner holds them. The result is in order of
    start, kind, end.
    """
    found = staged(secret_candidates(docs, repository, owner).withColumn("row", F.monotonically_increasing_id()))
    some = found.where(F.size("candidates") > 0)
    flat = some.select("row", F.explode("candidates").alias("c"))
    counts = ownership(some)
    verdict = F.when(F.col("n_owners") >= example_owners, "example").when(F.col("n_owners") > 1, "shared").when(F.col("n_repositories") > 1, "reused").otherwise("live")
    told = flat.join(counts, flat.c.hash == counts.hash).select(
        "row", F.struct(F.col("c.start").alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), F.col("c.kind")).alias("order"), F.col("c.end").alias("end"),
                        F.col("c.kind").alias("kind"), verdict.alias("verdict"), "n_documents", "n_repositories", "n_owners").alias("s"))
    told = told.where("s.kind <> 'random' or s.verdict in ('live', 'reused')")
    spans = told.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("spans"))  # bounded by one text's candidates
    return found.select("row", "doc_id").join(spans, "row", "left").select("doc_id", F.coalesce("spans", F.expr("array()")).alias("spans"))


def secret_digest(spans: DataFrame) -> DataFrame:
    """Counts, positions and verdict counts of secret_spans' rows, and the most repositories that one owner's value of theirs is in."""

    def joined(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def having(part: str, value: str):
        return F.size(F.filter("spans", lambda s: s[part] == value)).cast("long").alias(f"n_{value}")

    base = F.filter("spans", lambda s: s["kind"] != "random")
    return spans.select(
        "doc_id", *[having("kind", k) for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        *[having("verdict", v) for v in ("live", "reused", "shared", "example")],
        F.array_max(F.transform(F.filter("spans", lambda s: s["n_owners"] == 1), lambda s: s["n_repositories"])).alias("most_repositories"))
