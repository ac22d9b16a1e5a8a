"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Three base kinds are found by pattern. Besides, every long mixed token is a candidate. Candidate values are hashed
and aggregated over the corpus by distinct repositories and owners: a value that many owners carry is a copied
example, and so is one that lies in many repositories of one owner. One that few carry and that looks live is theirs:
its places are added as kind `owned`, and base spans with such a value are counted as live.

A match's place is the length of what `split` leaves before it, so positions never leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import table, written

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# runs from AKIA, or of hex digits, that fall short hold no other match: the least length can stand in the pattern
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
OWNED = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: A value that more owners, or more repositories, carry is a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
MASK = "[SECRET]"
_BLOCK = 256


def _matches(text: Column, pattern: str, value_group: int) -> Column:
    """array<struct<start,end,value>> of all matches, code points, in order."""
    whole, value, before = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)), F.split(text, pattern, -1)
    parts = F.zip_with(F.arrays_zip(whole.alias("w"), value.alias("v")), F.slice(before, F.lit(1), F.size(whole)), lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m["w"]).alias("long"), m["v"].alias("value")))
    return F.transform(F.array(parts), _placed)[0]


def _placed(parts: Column) -> Column:
    """Running positions; blocks keep the cost of appending in bounds for texts with very many matches."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        span = F.struct(start.alias("start"), (start + p["long"]).alias("end"), p["value"].alias("value"))
        return F.struct((start + p["long"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    def block(acc: Column, first: Column) -> Column:
        inner = F.aggregate(F.slice(parts, first, F.lit(_BLOCK)), F.struct(acc["at"].alias("at"), none.alias("spans")), step)
        return F.transform(F.array(inner), lambda r: F.struct(r["at"].alias("at"), F.concat(acc["spans"], r["spans"]).alias("spans")))[0]

    firsts = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts), F.lit(_BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(firsts, F.struct(F.lit(0).alias("at"), none.alias("spans")), block)["spans"]


def _kind(text: Column, pattern: str, kind: str, value_group: int = 0, worth: Column | None = None) -> Column:
    """Spans of one kind; texts without a match, nearly all, cost one search."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = F.when((worth if worth is not None else F.lit(True)) & text.rlike(pattern), _matches(text, pattern, value_group)).otherwise(none)
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def _joined(spans: Column) -> Column:
    named = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"], s["end"]))
    return F.concat_ws(",", named)


def candidates(docs: DataFrame, owner_col: str = "source", repository_cols: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(doc_id, version, owner, repository, base, more): base spans, and mixed tokens outside them, per row of docs.

    A repository is an owner with the values of repository_cols.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("version"),
        owner.alias("owner"),
        F.concat_ws("/", owner, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository_cols)).alias("repository"),
        F.filter(_kind(text, ASSIGN, "assign", 2), lambda s: F.length(s["value"]) >= 6).alias("assign"),
        _kind(text, ACCESS, "access", worth=text.contains("AKIA")).alias("access"),
        _kind(text, HEX, "hex").alias("hex"),
        F.filter(_kind(text, OWNED, "owned"), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")).alias("mixed"),
    )
    base = F.concat("assign", "access", "hex")
    apart = F.filter("mixed", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return rows.withColumn("base", base).select("doc_id", "version", "owner", "repository", "base", apart.alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """(h, owners, repositories) of each candidate value in the corpus; distinct triples first, so that no value's rows meet."""
    values = found.select("owner", "repository", F.explode(F.concat("base", "more")).alias("s")).select(F.sha2(F.col("s.value").cast("binary"), 256).alias("h"), "owner", "repository")
    by_owner = values.distinct().groupBy("h", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("h").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def find_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, salts: int = 8, owner_col: str = "source", repository_cols: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(doc_id, version, base, added, live): spans per row of docs, as arrays of (start, kind, end, value).

    Needs doc_id, text, owner_col and repository_cols; other columns are not looked at. Null and empty texts have no spans. A null
    owner is an owner of its own, a null doc_id stays null. Repeated rows each get their result, and count as one
    owner. `live` holds the base spans whose value few owners and repositories carry. An empty table gives no rows.
    """
    found = written(candidates(docs, owner_col, repository_cols), "secrets")
    places = found.select("doc_id", "version", F.explode(F.concat("base", "more")).alias("s")).select("doc_id", "version", "s", F.sha2(F.col("s.value").cast("binary"), 256).alias("h"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"))
    # each value's row is repeated for the salts: the places of one value that a third of all documents hold spread out
    counts = ownership(found).where((F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    rare = places.join(counts, ["h", "salt"]).groupBy("doc_id", "version").agg(F.collect_set("s").alias("own")).withColumnsRenamed({"doc_id": "__id", "version": "__version"})
    joined = found.join(rare, found["doc_id"].eqNullSafe(rare["__id"]) & (found["version"] == rare["__version"]), "left")
    own = F.coalesce("own", F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))
    return joined.select("doc_id", "version", "base", F.filter(own, lambda s: s["kind"] == 3).alias("added"), F.filter(own, lambda s: s["kind"] < 3).alias("live"))


def mask_secrets(docs: DataFrame, mask: str = MASK, **how) -> DataFrame:
    """docs with every span, base or added, replaced by `mask`; all columns and all rows stay."""
    spans = find_secrets(docs, **how).select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"), F.array_sort(F.concat("base", "added")).alias("__spans"))
    spans = spans.where(F.size("__spans") > 0).dropDuplicates(["__id", "__version"])
    joined = docs.join(spans, docs["doc_id"].cast("long").eqNullSafe(spans["__id"]) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == spans["__version"]), "left")

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.when(fresh, F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    done = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return joined.withColumn("text", F.when(F.size("__spans") > 0, done).otherwise(F.col("text"))).drop("__id", "__version", "__spans")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """find_secrets() of all documents, as counts and span lists."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"),
        # the same value may stand in several places of a text, `live` holds each of them
        F.size("live").cast("long").alias("n_live"), F.size("added").cast("long").alias("n_owned"),
    )


def _sql_kind(number: int, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
select * from (select doc_id, source, lang, {number} kind, s + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) start_, length(ms[i]) n, vs[i] v
from (select *, list_sum(list_transform(ps[1:i], lambda x: length(x))) s
      from (select *, unnest(range(1, len(ms) + 1)) i
            from (select doc_id, source, lang, regexp_extract_all(text, '{p}', 0) ms, regexp_extract_all(text, '{p}', {group}) vs, string_split_regex(text, '{p}') ps from documents)))) where {keep}"""


OP3_SQL = f"""
with base as ({_sql_kind(0, ASSIGN, 2, "length(v) >= 6")} union all {_sql_kind(1, ACCESS, 0, "true")} union all {_sql_kind(2, HEX, 0, "true")}),
mixed as ({_sql_kind(3, OWNED, 0, "regexp_matches(v, '[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]')")}),
more as (select * from mixed m where not exists (select 1 from base b where b.doc_id = m.doc_id and b.start_ < m.start_ + m.n and m.start_ < b.start_ + b.n)),
owners as (select v, count(distinct coalesce(source, '')) o, count(distinct coalesce(source, '') || '/' || coalesce(lang, '')) r from (select * from base union all select * from more) group by v),
few as (select v from owners where o <= {MAX_OWNERS} and r <= {MAX_REPOSITORIES}),
spans as (select doc_id, kind, start_, n, v in (select v from few) live from base union all select doc_id, kind, start_, n, false from more join few using (v)),
named as (select *, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start_ || ':' || (start_ + n) t from spans),
per as (select doc_id, count(*) filter (kind = 0) a, count(*) filter (kind = 1) c, count(*) filter (kind = 2) h, count(*) filter (live) l, count(*) filter (kind = 3) w,
        string_agg(t, ',' order by start_, kind) filter (kind < 3) b, string_agg(t, ',' order by start_, kind) al from named group by doc_id)
select d.doc_id, coalesce(a, 0)::bigint n_assign, coalesce(c, 0)::bigint n_access, coalesce(h, 0)::bigint n_hex, sha256(coalesce(b, '')) base_sha256, coalesce(al, '') spans, coalesce(l, 0)::bigint n_live, coalesce(w, 0)::bigint n_owned
from documents d left join per using (doc_id)
"""
