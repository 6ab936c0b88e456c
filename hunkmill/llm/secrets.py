"""Secret scan with corpus-wide ownership frequency.

Base spans are the leftmost non-overlapping matches of three fixed patterns, per kind. The method adds the kind
`owned`: bare tokens of 20 or more characters that mix upper case, lower case and digits. Every candidate value
(base or bare) is hashed and counted over the corpus by distinct repositories and owners, aggregated before each
shuffle; a value found with `common_owners` owners or in `common_repos` repositories or more is a widely copied
example, one that a single owner holds in fewer is live-looking. Bare tokens become spans only when one owner alone holds them; base spans always stay, and are
counted as live or copied.

Defined cases: null text is empty and has no spans; a text of any length is searched whole, in time linear in it; a null owner or repository is one of its own; repeated rows
each get a row with the same spans, and count once per repository; no tokens, empty tables and clashing columns
are plain cases of the same rules.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy, with_groups

#: Fixed patterns of the contract: group 2 of an assignment needs 6 characters, a key id 20, hex digits 24.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "owned")
BARE = r"[A-Za-z0-9+/_-]{20,}"

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs that are long enough
_BARE = re.compile(BARE)
#: A text without any of these has no candidate; tested on whole batches outside Python.
_ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[A-Za-z0-9+/_-]{20}"

SPAN = "struct<kind:int,start:int,stop:int,value:string>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    found = [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return found


def bare_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Bare tokens that mix cases and digits and overlap no span of `taken`; both are walked once in order."""
    out, at = [], 0
    taken = sorted(taken, key=lambda s: s[1])
    # The furthest end among the spans that start no later: spans of different kinds may overlap.
    ends = list(accumulate((s[2] for s in taken), max))
    for m in _BARE.finditer(text):
        while at < len(taken) and taken[at][1] < m.end():
            at += 1
        if at and ends[at - 1] > m.start():
            continue
        v = m[0]
        if any(c.isdigit() for c in v) and v.lower() != v and v.upper() != v:
            out.append((3, m.start(), m.end(), v))
    return out


def _scan(batches):
    for batch in batches:
        text = pc.fill_null(batch.column("text"), "")
        likely = pc.match_substring_regex(text, _ANY).to_numpy(zero_copy_only=False)
        spans = []
        for i in range(len(text)):
            found = []
            if likely[i]:
                t = text[i].as_py()
                found = base_spans(t)
                found = sorted(found + bare_spans(t, found), key=lambda s: (s[1], s[0]))
            spans.append([{"kind": k, "start": s, "stop": e, "value": v} for k, s, e, v in found])
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("owner"), batch.column("repo"), pa.array(spans, kind)], names=["doc_id", "owner", "repo", "spans"])


def ownership(candidates: DataFrame, common_owners: int = 3, common_repos: int = 20) -> DataFrame:
    """value_hash, repos, owners, status (live, shared, example) for rows (value_hash, owner, repo).

    A value of common_owners owners or of common_repos repositories, whoever owns them, is a widely copied example;
    one that a single owner holds in fewer repositories is live-looking. Counted by (value, owner, repo), then
    (value, owner), then value: no step gathers a value's rows in a task.
    """
    by_repo = candidates.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    out = by_owner.groupBy("value_hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"), F.sum("n").alias("occurrences"))
    example = (F.col("owners") >= common_owners) | (F.col("repos") >= common_repos)
    return out.withColumn("status", F.when(example, "example").when(F.col("owners") == 1, "live").otherwise("shared"))


@tidy
def scan_secrets(docs: DataFrame, owner: str = "source", repo: str = "doc_id", common_owners: int = 3, common_repos: int = 20) -> DataFrame:
    """doc_id and spans (kind, start, stop, value_hash, repos, owners, status), one row for each row of docs."""
    rows = docs.select("doc_id", "text", F.coalesce(F.col(owner).cast("string"), F.lit("\0null")).alias("owner"), F.coalesce(F.col(repo).cast("string"), F.lit("\0null")).alias("repo"))
    rows = rows.mapInArrow(_scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, owner string, repo string, spans array<{SPAN}>")
    # Values leave this step as hashes only; the row number tells repeated rows apart once it is written.
    hashed = F.transform("spans", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.stop.alias("stop"), F.sha2(s.value.cast("binary"), 256).alias("value_hash")))
    rows = materialise(rows.select("doc_id", "owner", "repo", hashed.alias("spans"), F.monotonically_increasing_id().alias("nth")), "secrets")
    each = materialise(rows.select("nth", "owner", "repo", F.explode("spans").alias("s")).select("nth", "owner", "repo", "s.*"), "candidates")
    freq = materialise(ownership(each.select("value_hash", "owner", "repo"), common_owners, common_repos), "ownership")
    # A value copied everywhere is met by broadcast, so its rows never meet in one task.
    found = with_groups(each.select("nth", "kind", "start", "stop", "value_hash"), freq, ["value_hash"], "occurrences", each.count())
    found = found.filter((F.col("kind") < KINDS.index("owned")) | (F.col("status") == "live"))
    found = found.groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop", "value_hash", "repos", "owners", "status"))).alias("found"))
    bare = rows.filter(F.size("spans") == 0).select("doc_id", F.array().cast(found.schema["found"].dataType).alias("spans"))
    full = rows.filter(F.size("spans") > 0).select("nth", "doc_id").join(found, "nth", "left")
    return bare.unionByName(full.select("doc_id", F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("spans")))


def digest(scan: DataFrame) -> DataFrame:
    """The contract's columns from scan_secrets' rows."""
    names = F.array(*[F.lit(k) for k in KINDS])
    show = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.stop.cast("string"))), ",")
    of = lambda i: F.size(F.filter("spans", lambda s: s.kind == i)).cast("long")
    have = lambda status: F.size(F.filter("spans", lambda s: s.status == status)).cast("long")
    base = F.filter("spans", lambda s: s.kind < KINDS.index("owned"))
    return scan.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(show(base).cast("binary"), 256).alias("base_sha256"),
        show(F.col("spans")).alias("spans"), have("live").alias("n_live"), have("shared").alias("n_shared"), have("example").alias("n_example"),
    )
