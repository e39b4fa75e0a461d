"""Secret scans by corpus-wide ownership frequency, with DataFrame functions only.

Patterns find candidates in each text. Digests of their values are then counted over the corpus by
distinct repositories and distinct owners. A value that ``many_owners`` hold, or that two hold in ``many_repos``
repositories, is a copied example; one that a single owner holds, in however many repositories, or that two hold
in few, looks like a live credential of theirs. Distinct pairs are formed first (with partial
aggregation before the shuffle), so a value that half of the corpus repeats costs one row a pair and
its counting is spread over the pairs; the verdicts then join the candidates by digest, a join that
Spark may split where a value is hot.

Base kinds (assign, access, hex) are always reported; further kinds (``MORE``) are reported only
where the verdict is live. Positions are code points, end exclusive.

Edge cases: a null text is empty; a very long text is scanned whole, in time linear in its length but with the square of
the number of its candidates; null repository or owner is a value like any other; candidates of
rows with a null doc_id count; repeated rows hold the same spans and count as one repository; ties
don't arise, for spans are ordered by start, kind and end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, fields_of, row_of, text_of

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
#: kind -> pattern of the further kinds; one scan looks for all of them
MORE = {
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "bearer": r"[Bb]earer [A-Za-z0-9._~+/-]{20,}",
    "hosting": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "chat": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "payment": r"[sr]k_live_[A-Za-z0-9]{16,}",
    "cloud": r"AIza[0-9A-Za-z_-]{35}",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\t\n\f\r ]*",
    "url_login": r"://[^\t\n\f\r :/@]{1,64}:[^\t\n\f\r :/@]{1,64}@",
}
KINDS = ["assign", "access", "hex", *MORE]
MANY_OWNERS = 3
MANY_REPOS = 20
MASK = "[SECRET]"

_SPAN = "struct<start:bigint,kind_no:int,end:bigint,kind:string,value:string>"


def _spans(text: Column, pattern: str, kind: Column | str, group: int = 0, least: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches whose ``group`` has ``least`` characters or more.

    What lies between the matches comes from a split by the same pattern; lengths of both, added up,
    give the positions. Texts without a match are looked at once.
    """
    pat = F.lit(pattern)
    empty = F.array().cast(f"array<{_SPAN}>")
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, pat, F.lit(0))
    values = matches if group == 0 else F.regexp_extract_all(text, pat, F.lit(group))
    each = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("gap"), matches.alias("hit"), values.alias("value"))

    def named(x: Column) -> tuple[Column, Column]:
        if isinstance(kind, str):
            return F.lit(KINDS.index(kind)), F.lit(kind)
        name = F.coalesce(*[F.when(x.rlike(f"^(?:{p})"), F.lit(k)) for k, p in MORE.items()])
        return F.array_position(F.array(*[F.lit(k) for k in KINDS]), name).cast("int") - 1, name

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        no, name = named(x["hit"])
        span = F.struct(start.alias("start"), no.alias("kind_no"), end.alias("end"), name.alias("kind"), x["value"].alias("value")).cast(_SPAN)
        kept = F.when(F.length(x["value"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    found = F.aggregate(each, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step)["out"]
    return F.when(text.rlike(pattern), found).otherwise(empty)


def candidates(text: Column) -> Column:
    """All candidates of a text, by start, then kind."""
    more = "|".join(f"(?:{p})" for p in MORE.values())
    return F.array_sort(F.concat(
        _spans(text, ASSIGN, "assign", group=1, least=8),
        F.when(text.contains("AKIA"), _spans(text, ACCESS, "access")).otherwise(F.array().cast(f"array<{_SPAN}>")),
        _spans(text, HEX, "hex"),
        _spans(text, more, F.lit(None)),
    ))


def scanned(docs: DataFrame, repository: str = "doc_id", owner: str = "source", whole: bool = False) -> DataFrame:
    """doc_id, repo, owner, key and ``found`` (spans with digests, no values) of every row, and ``row`` if whole rows
    are wanted; texts are scanned once.

    ``key`` names the row's text and id where it has candidates, else it only spreads the row.
    """
    rows = docs.select(row_of(docs), F.col("doc_id"), F.col(repository).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), text_of().alias("text"))
    rows = rows.withColumn("c", candidates(F.col("text")))
    slim = F.transform("c", lambda x: F.struct(x["start"], x["kind_no"], x["end"], x["kind"], F.unhex(F.sha2(x["value"], 256)).alias("digest")))
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    key = F.when(F.size("c") > 0, F.md5(F.concat(own, F.lit(":"), F.col("text")))).otherwise(F.concat(F.lit("-"), F.xxhash64("doc_id", "text").cast("string")))
    return cut(rows.select(*(["row"] if whole else []), "doc_id", "repo", "owner", key.alias("key"), slim.alias("found")))


def ownership(scan: DataFrame) -> DataFrame:
    """digest, n_repos, n_owners, over the whole corpus."""
    each = scan.select("repo", "owner", F.explode("found").alias("f")).select(F.col("f.digest").alias("digest"), "repo", "owner")
    pairs = each.groupBy("digest", "repo", "owner").agg(F.lit(1).alias("one"))
    repos = pairs.groupBy("digest", "repo").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("n_repos"))
    owners = pairs.groupBy("digest", "owner").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("n_owners"))
    return repos.join(owners, "digest")


def verdicts(scan: DataFrame, many_owners: int = MANY_OWNERS, many_repos: int = MANY_REPOS) -> DataFrame:
    """(key, live, copied): arrays of spans of the rows with candidates, by verdict."""
    each = scan.select("key", F.explode("found").alias("f")).select("key", "f.*").distinct()
    copied = (F.col("n_owners") >= many_owners) | (F.col("n_owners") > 1) & (F.col("n_repos") >= many_repos)
    judged = each.join(ownership(scan).select("digest", (~copied).alias("live")), "digest")
    span = F.struct("start", "kind_no", "end", "kind")
    return judged.groupBy("key").agg(F.array_sort(F.collect_set(F.when(F.col("live"), span))).alias("live"), F.array_sort(F.collect_set(F.when(~F.col("live"), span))).alias("copied"))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source", **many) -> DataFrame:
    """doc_id, base and added spans, and how many of all candidates look live or copied."""
    scan = scanned(docs, repository, owner)
    by_key = verdicts(scan, **many)
    plain = F.transform("found", lambda x: F.struct(x["start"], x["kind_no"], x["end"], x["kind"]))
    base = F.filter(plain, lambda x: x["kind_no"] < 3)
    none = F.filter(plain, lambda x: F.lit(False))
    live = F.coalesce(F.col("live"), none)
    return scan.join(by_key, "key", "left").select(
        "doc_id", base.alias("base"), F.array_sort(F.concat(base, F.filter(live, lambda x: x["kind_no"] >= 3))).alias("spans"),
        F.size(live).cast("long").alias("n_live"), F.coalesce(F.size("copied"), F.lit(0)).cast("long").alias("n_copied"),
    )


def redacted(docs: DataFrame, repository: str = "doc_id", owner: str = "source", **many) -> DataFrame:
    """``docs`` with every live-looking span, base or further, replaced by ``[SECRET]``; ``n_chars``, if
    there, follows. Rows without candidates are not shuffled; copied examples stay."""
    scan = scanned(docs, repository, owner, whole=True)
    some = F.size("found") > 0
    hit = scan.where(some).select("row", F.col("row.text").alias("text"), "key")
    joined = hit.join(verdicts(scan, **many).select("key", "live"), "key", "left")

    def step(acc: Column, x: Column) -> Column:
        between = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        fresh = F.when(x["start"] >= acc["at"], F.concat(acc["out"], between, F.lit(MASK))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), fresh.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(F.col("live"), start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length(F.col("text")))))
    out = joined.withColumn("masked", F.when(F.size("live") > 0, done).otherwise(F.col("text")))
    changed = {"text": F.col("masked").alias("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("live") > 0, F.length("masked")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return scan.where(~some).select(*fields_of(docs)).unionByName(out.select(*[changed.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns]))
