"""Secret scans: candidates by pattern, told apart by who else holds them.

Candidates are found in each text by built-in regular expressions.  The value
of each is hashed, and over the whole corpus the distinct repositories and
owners of each hash are counted.  A value that many owners or repositories hold
is a copied example; one that few hold and that looks random is taken for live.

Counts of distinct owners are combined before each shuffle, so a value that
occurs in a third of all rows costs no task more than its owners; the join of
candidates with these counts reads plain exchanges on both sides, which
adaptive execution splits.  Texts are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.text import free_name, let, running, settle
from corpusmill.storage import cut

#: Kind, pattern, group of the value, least length of the value.  In this order kinds are listed.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
)
#: Values with these are placeholders, whoever holds them.
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|your|xxxx|\*\*\*|1234567|abcdef0|test"
CANDIDATE = "array<struct<s:int,k:int,e:int,vs:int,v:string>>"


def _found(text: Column, k: int, pattern: str, group: int, least: int) -> Column:
    """The candidates of one kind: ``(s, k, e, vs, v)``, places in code points."""

    def spans(parts: Column) -> Column:
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: let(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits, lambda values: let(
                F.transform(hits, lambda h, i: F.length(F.get(parts, i)) + F.length(h)), lambda widths: let(
                    running(widths, F.lit(0), lambda a, x: a + x), lambda before: F.filter(F.transform(values, lambda v, i: let(
                        F.get(before, i) + F.get(widths, i), lambda e: F.struct(
                            (e - F.length(F.get(hits, i))).alias("s"), F.lit(k).alias("k"), e.alias("e"), (e - F.length(v)).alias("vs"), v.alias("v")))),
                        lambda x: F.length(x["v"]) >= least)))))

    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), spans)).otherwise(F.expr(f"CAST(array() AS {CANDIDATE})"))


def candidates(text: Column) -> Column:
    """All base candidates of a text, by place, then kind."""
    value = F.coalesce(text, F.lit(""))
    return F.sort_array(F.concat(*[_found(value, i, p, g, n) for i, (_, p, g, n) in enumerate(KINDS)]))


def ownership(found: DataFrame) -> DataFrame:
    """``(h, n_repos, n_owners)`` of value hashes, from rows ``(h, repo, owner)``; exact."""
    held = found.select("h", "repo", "owner").distinct()
    return held.groupBy("h").agg(F.count("*").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))


def secret_scan(df: DataFrame, key: str = "doc_id", text: str = "text", repo: Column | None = None, owner: Column | None = None, max_owners: int = 2, max_repos: int = 5) -> DataFrame:
    """One row for each row of ``df``: ``key`` and ``secrets``.

    ``secrets``: array of (s, k, e, vs, v, status) by place, where ``k`` is the
    place of the kind in ``KINDS``, ``[s, e)`` the match, ``[vs, e)`` the value
    ``v`` in code points, and ``status`` is ``live`` (few owners and random
    looks), ``example`` (more than ``max_owners`` owners or ``max_repos``
    repositories) or ``weak``.

    ``repo`` and ``owner`` say who holds a row; by default both are unknown and
    each row stands for itself.  Defined results: null text counts as empty; a
    null owner counts as an owner of its own; repeated rows are joined by
    their own row, so ``key`` may repeat or be null; other columns are not
    read; an empty table gives an empty one.
    """
    me = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("?"))
    repo, owner = (F.coalesce(x.cast("string"), F.lit("?")) if x is not None else me for x in (repo, owner))
    rows = cut(settle(df.select(F.col(f"`{key}`").alias("key"), repo.alias("repo"), owner.alias("owner"), F.col(f"`{text}`").alias("text")), {"found": candidates(F.col("text"))}).drop("text").withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = rows.where("size(found) > 0").select("row", "repo", "owner", F.inline("found")).withColumn("h", F.sha2("v", 256))
    known = cut(ownership(each), "owners")
    letters = F.size(F.array_distinct(F.split("v", "")))
    looks = (letters >= 6) & F.col("v").rlike("[0-9]") & F.col("v").rlike("[A-Za-z]") & ~F.col("v").rlike(PLACEHOLDER)
    status = F.when((F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos), "example").when(looks, "live").otherwise("weak")
    judged = each.join(known, "h").select("row", F.struct("s", "k", "e", "vs", "v", status.alias("status"), "n_repos", "n_owners").alias("x"))
    judged = judged.groupBy("row").agg(F.sort_array(F.collect_list("x")).alias("secrets"))
    none = F.expr("CAST(array() AS array<struct<s:int,k:int,e:int,vs:int,v:string,status:string,n_repos:bigint,n_owners:bigint>>)")
    return rows.select("row", F.col("key").alias(key)).join(judged, "row", "left").select(key, F.coalesce("secrets", none).alias("secrets"))


def redact(text: Column, secrets: Column) -> Column:
    """``text`` with the value of each secret replaced, overlapping ones as one.

    A value that is not a copied example becomes ``[SECRET]``, a copied example
    ``[EXAMPLE]``; a null text stays null.  Values are replaced in blocks, each
    of which is cut out of the text once.
    """
    own = F.transform(secrets, lambda x: F.struct(x["vs"].alias("vs"), x["e"].alias("e"), (x["status"] != "example").alias("live")))

    def merged(x: Column) -> Column:
        ends = running(F.transform(x, lambda y: y["e"]), F.lit(0), lambda a, e: F.greatest(a, e))
        first = let(ends, lambda far: F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i)["vs"] >= F.get(far, i)))
        return let(first, lambda at: F.transform(at, lambda i, g: let(
            F.slice(x, i + 1, F.coalesce(F.get(at, g + 1), F.size(x)) - i), lambda same: F.struct(
                F.get(same, 0)["vs"].alias("vs"), F.array_max(F.transform(same, lambda y: y["e"])).alias("e"), F.exists(same, lambda y: y["live"]).alias("live")))))

    def written(x: Column) -> Column:
        def block(size: Column) -> Column:
            def one(b: Column) -> Column:
                return let(F.slice(x, b * size + 1, size), lambda part: let(F.coalesce(F.get(x, b * size - 1)["e"], F.lit(0)), lambda at: let(
                    F.substring(text, at + 1, F.element_at(part, -1)["e"] - at), lambda cut_out: F.array_join(F.transform(part, lambda y, j: let(
                        F.coalesce(F.get(part, j - 1)["e"], at), lambda since: F.concat(
                            F.substring(cut_out, since - at + 1, y["vs"] - since), F.when(y["live"], "[SECRET]").otherwise("[EXAMPLE]")))), ""))))

            return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / size).cast("int")), one), "")

        tail = let(F.element_at(x, -1)["e"], lambda e: F.substring(text, e + 1, F.length(text)))
        return F.concat(let(F.ceil(F.sqrt(F.size(x))).cast("int"), block), tail)

    return F.when(F.size(secrets) == 0, text).otherwise(let(let(F.sort_array(own), merged), written))


def redact_secrets(df: DataFrame, text: str = "text", repo: Column | None = None, owner: Column | None = None, max_owners: int = 2, max_repos: int = 5) -> DataFrame:
    """``df`` with the secrets in ``text`` replaced; rows, order of columns and types stay.

    Only texts with a candidate are joined with what the scan says of them, by
    the hash of the text, so neither keys nor repeated rows matter.
    """
    has = F.size(candidates(F.col(f"`{text}`"))) > 0
    own = free_name(df.columns, "_text_hash")
    hit = df.where(has).withColumn(own, F.sha2(F.col(f"`{text}`"), 256))
    found = cut(secret_scan(hit, own, text, repo, owner, max_owners, max_repos).dropDuplicates([own]).withColumnRenamed("secrets", own + "s"), "found")
    clean = hit.join(found, own).withColumn(text, redact(F.col(f"`{text}`"), F.col(own + "s")))
    return df.where(~has).union(clean.select(*[F.col(f"`{c}`") for c in df.columns]))


def digest(secrets: Column) -> dict[str, Column]:
    """The contract's columns, from ``secrets``."""
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    told = lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])
    base = F.array_join(F.transform(secrets, told), ",")
    live = F.transform(F.filter(secrets, lambda x: x["status"] == "live"), lambda x: F.struct(x["vs"].alias("s"), F.lit(len(KINDS)).alias("k"), F.concat_ws(":", F.lit("live"), x["vs"], x["e"]).alias("t")))
    every = F.sort_array(F.concat(F.transform(secrets, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), told(x).alias("t"))), F.array_distinct(live)))
    count = lambda i: F.size(F.filter(secrets, lambda x: x["k"] == i)).cast("long")
    return {f"n_{k}": count(i) for i, (k, *_) in enumerate(KINDS)} | {
        "base_sha256": F.sha2(base, 256), "spans": F.array_join(F.transform(every, lambda x: x["t"]), ","),
        "n_live": F.size(F.filter(secrets, lambda x: x["status"] == "live")).cast("long"),
        "n_example": F.size(F.filter(secrets, lambda x: x["status"] == "example")).cast("long")}


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over all documents; a source owns one repository a language.

    A null or empty text has no spans; very long texts are scanned whole; spans of
    one start come in the order of their kinds; repeated rows are returned each; an
    empty table gives an empty one; other columns are not read.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secret_scan(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    return found.select("doc_id", *[c.alias(k) for k, c in digest(F.col("secrets")).items()])


_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _kind_sql(k: int, pattern: str, group: int, least: int) -> str:
    return f"""SELECT doc_id, source, lang, {k} AS k, m, v, sum(before) OVER w - length(m) AS s, sum(before) OVER w AS e FROM (
      SELECT doc_id, source, lang, m, v, length(part) + length(m) AS before, i FROM (
        SELECT doc_id, source, lang, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_extract_all(t, '{pattern}', {group})) AS v, unnest(string_split_regex(t, '{pattern}')) AS part, unnest(range(length(t) + 1)) AS i
        FROM d WHERE regexp_matches(t, '{pattern}')) WHERE m IS NOT NULL)
    WINDOW w AS (PARTITION BY doc_id ORDER BY i) QUALIFY length(v) >= {least}"""


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
c AS ({_kind_sql(0, _ASSIGN, 2, 8)} UNION ALL {_kind_sql(1, KINDS[1][1], 0, 16)} UNION ALL {_kind_sql(2, KINDS[2][1], 0, 32)}),
o AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT concat_ws('/', source, lang)) AS repos FROM c GROUP BY v),
j AS (SELECT c.*, e - length(v) AS vs, CASE WHEN owners > 2 OR repos > 5 THEN 'example' WHEN len(list_distinct(string_split(v, ''))) >= 6 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '{PLACEHOLDER}') THEN 'live' ELSE 'weak' END AS status FROM c JOIN o USING (v)),
n AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, count(*) FILTER (WHERE status = 'live') AS n_live, count(*) FILTER (WHERE status = 'example') AS n_example,
  string_agg(['assign', 'access', 'hex'][k + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS base FROM j GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(['assign', 'access', 'hex', 'live'][k + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) AS spans FROM (SELECT doc_id, k, s, e FROM j UNION ALL SELECT DISTINCT doc_id, 3, vs, e FROM j WHERE status = 'live') GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id
"""
