"""Secret scan by corpus-wide ownership frequency.

Each text yields base spans (assignments, access keys, long hex strings) and further candidates: long tokens
of mixed characters and high entropy outside any base span. The worker hashes every candidate's value and
forgets it: no secret is written anywhere. The corpus tells by how many distinct repositories and owners each
value is held. Documents have no repository of their own, so each stands for one, and its source for the owner.
A value that at least ``copied`` owners or ``forked`` repositories hold is a widely copied example; one held by
fewer of both is owner-specific and looks live. Live candidates are added as spans of kind ``value``; base spans
stay, and are counted as live or copied.

A worker reduces each text to its spans at once. Frequencies are counted over distinct (value, owner) and
(value, repository) pairs, pre-aggregated in each task, and the verdict goes back to the spans by a join that
splits hot values, so a secret that a third of all documents hold overloads no task.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import join_split, materialise
from .common import chunks
from .spans import SECRET, digest, joined, secrets

_token = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")


def entropy(s: str) -> float:
    """Bits per character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def candidates(text: str, base: list[tuple]) -> list[tuple[int, int, str]]:
    """Tokens of 20 or more characters with letters and digits and 3 bits a character, apart from all base spans."""
    taken: list[list[int]] = []
    for _, s, e, *_ in sorted(base, key=lambda x: x[1]):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out, k = [], 0
    for m in _token.finditer(text):
        s = m.group()
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        if any("0" <= c <= "9" for c in s) and any(c.isalpha() for c in s) and entropy(s) >= 3.0:
            out.append((m.start(), m.end(), s))
    return out


def scan(docs: DataFrame, copied: int = 3, repo_col: str = "doc_id", owner_col: str = "source", id_col: str = "doc_id", text_col: str = "text", forked: int = 10) -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex (base spans), n_live, n_copied, n_value, n_secrets (all spans), base_sha256, spans.

    Null and empty texts have no spans. A null repository or owner counts as one of its own kind. Repeated rows
    and null ids get a row each; an empty table gives no rows; other columns are not read, whatever their names.
    Values are told apart by their SHA-256. Texts of any length are scanned whole.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(repo_col).cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, repo string, owner string, " + ", ".join(f"n_{k} long" for k in SECRET)
    schema += ", base_sha256 string, base string, held array<struct<kind:string,s:long,e:long,h:binary>>"
    struct = pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("h", pa.binary())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                base, held = [], []
                for text in batch.column("text").to_pylist():
                    found = secrets(text or "")
                    base.append(found)
                    every = found + [("value", *x) for x in candidates(text or "", found)]
                    held.append([{"kind": k, "s": s, "e": e, "h": hashlib.sha256(v.encode("utf-8", "surrogatepass")).digest()} for k, s, e, v in every])
                out = {c: batch.column(c) for c in ("doc_id", "repo", "owner")}
                out |= {f"n_{k}": pa.array([sum(x[0] == k for x in b) for b in base], pa.int64()) for k in SECRET}
                out |= {"base_sha256": pa.array([digest(b) for b in base]), "base": pa.array([joined(b) for b in base]), "held": pa.array(held, pa.list_(struct))}
                yield pa.RecordBatch.from_pydict(out)

    rows = materialise(narrow.mapInArrow(find, schema).withColumn("row", F.monotonically_increasing_id()))
    spans = rows.select("row", "repo", "owner", F.explode("held").alias("x")).select("row", "repo", "owner", "x.kind", "x.s", "x.e", "x.h")
    total = rows.agg(F.coalesce(F.sum(F.size("held")), F.lit(0))).first()[0]
    repos = spans.groupBy("h", "repo").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("n_repos"), F.sum("n").alias("n"))
    owners = spans.groupBy("h", "owner").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n_owners"))
    verdict = materialise(repos.join(owners, "h").select("h", "n", ((F.col("n_owners") < copied) & (F.col("n_repos") < forked)).alias("live")))
    judged = join_split(spans.select("row", "kind", "s", "e", "h"), verdict.drop("n"), "h", verdict.select("h", "n"), total)
    of_row = judged.groupBy("row").agg(
        F.count_if((F.col("kind") != "value") & F.col("live")).alias("n_live"),
        F.count_if((F.col("kind") != "value") & ~F.col("live")).alias("n_copied"),
        F.collect_list(F.when((F.col("kind") == "value") & F.col("live"), F.struct("s", "e"))).alias("more"),
    )
    out = rows.drop("repo", "owner", "held").join(of_row, "row", "left")
    kinds = F.array(*map(F.lit, [*SECRET, "value"]))
    part = lambda x: F.split(x, ":")
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(part(x)[1].cast("long").alias("s"), F.array_position(kinds, part(x)[0]).alias("k"), part(x)[2].cast("long").alias("e")))
    more = F.transform(F.coalesce("more", F.array().cast("array<struct<s:bigint,e:bigint>>")), lambda x: F.struct(x["s"].alias("s"), F.lit(len(SECRET) + 1).cast("long").alias("k"), x["e"].alias("e")))
    every = F.array_join(F.transform(F.sort_array(F.concat(base, more)), lambda x: F.concat_ws(":", F.element_at(kinds, x["k"].cast("int")), x["s"].cast("string"), x["e"].cast("string"))), ",")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    n_value = F.coalesce(F.size("more"), F.lit(0)).cast("long")
    n_all = sum((F.col(f"n_{k}") for k in SECRET), n_value)
    return out.select(F.col("doc_id").alias(id_col), *[f"n_{k}" for k in SECRET], zero("n_live"), zero("n_copied"), n_value.alias("n_value"), n_all.alias("n_secrets"), "base_sha256", every.alias("spans"))
