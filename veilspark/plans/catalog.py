"""The queries of the engine, each with the SQL that gives the same rows, where SQL can.

Queries read the given tables, or case files that Spark derives from them.
"""

from __future__ import annotations

import copy
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import values as V
from ..functions.spans import cut, let
from ..operators import candidates as C
from ..operators import addresses, augment, consistency, decode, marked, names, organisations, realistic, rewrite, tiles, tolerant
from . import casefiles, evaluate
from .deidentify import Engine
from .shared import kept, shared_path, unsent

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_ENGINES: dict[str, Engine] = {}


def engine(spark: SparkSession, spread: bool = False) -> Engine:
    """One for each Spark application: its expressions are built once. `spread` is for few and long documents."""
    found = _ENGINES.setdefault(spark.sparkContext.applicationId, Engine())
    found._generators()
    wide = copy.copy(found)
    wide.spread = spread
    return wide


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def sql_spans(source: str, key: str, text: str, pattern: str) -> str:
    """DuckDB: key, start, end, value of the matches of a pattern without look-around."""
    return f"""
    with marked as (select {key}, string_split(regexp_replace({text}, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as p from {source}),
    parts as (select {key}, unnest(p) as part, generate_subscripts(p, 1) as i from marked),
    placed as (select {key}, i, part, sum(length(replace(part, chr(2), ''))) over (partition by {key} order by i) - length(replace(part, chr(2), '')) as pos from parts)
    select {key}, cast(pos as int) as start, cast(pos + length(split_part(part, chr(2), 1)) as int) as "end", split_part(part, chr(2), 1) as value from placed where i > 1"""


EMAIL_SQL = P.EMAIL.replace("\\-", "-")
EMAILS = sql_spans("documents", "doc_id", "text", EMAIL_SQL)


def email_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exploded(docs_of(spark, sf_dir), "doc_id", C.typed(C.emails(F.col("text")), "email")).drop("kind")


@query(EMAILS)
def scan_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return email_rows(spark, sf_dir)


#: URLs without look-around, which DuckDB's patterns lack: a scheme or www., and what follows.
SCHEMED = r"(?:https?://|line://|www\.)[^\s，。、；！？「」『』（）()<>一-鿿㐀-䶿]+"


@query(
    f"""select page_id, start, cast(start + length(v) as int) as "end", v as value from
    (select page_id, start, regexp_replace(value, '[.,;:!?)\\]」』''"`>]+$', '') as v from ({sql_spans("pages", "page_id", "html", SCHEMED)}))""".replace("\\\\", "\\")
)
def scan_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with a scheme in whole pages; addresses without one follow other rules and are tested apart."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("html").alias("text"))
    return C.exploded(pages, "page_id", C.typed(C.urls(F.col("text")), "url")).drop("kind").where(F.col("value").rlike(r"^(?:https?://|line://|www\.)"))


@query()
def scan_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.structured(docs_of(spark, sf_dir))


@query()
def scan_case_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.structured(casefiles.documents(spark, sf_dir))


@query(sql_spans("documents", "doc_id", "text", "[A-Z][a-z]+(?:[- ][A-Z][a-z]+)+") + " and false union all select doc_id, cast(0 as int), cast(count(*) as int), 'words' from (" + sql_spans("documents", "doc_id", "regexp_replace(text, '[^A-Za-z]', ' ', 'g')", "[A-Za-z]+") + ") group by doc_id")
def scan_words_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.spans import match_spans

    found = docs_of(spark, sf_dir).select("doc_id", F.size(match_spans(F.col("text"), "(?<![A-Za-z])[A-Za-z]+(?![A-Za-z])")).alias("end"))
    return found.where(F.col("end") > 0).select("doc_id", F.lit(0).alias("start"), "end", F.lit("words").alias("value"))


NUMBERS = f"""with runs as ({sql_spans("documents", "doc_id", "text", "[0-9０-９]+")}),
    near as (select r.doc_id, r.start, r."end", substr(d.text, r.start, 1) as b1, case when r.start >= 2 then substr(d.text, r.start - 1, 1) else '' end as b2, substr(d.text, r."end" + 1, 1) as a1, substr(d.text, r."end" + 2, 4) as a4, d.text from runs r join documents d using (doc_id)),
    kept as (select *, row_number() over (partition by doc_id order by start) as i from near where not (
      (start > 0 and b1 = ',' and regexp_matches(b2, '[0-9０-９]') and "end" - start = 3) or (a1 = ',' and (regexp_full_match(a4, '[0-9０-９]{{3}}') or regexp_matches(a4, '^[0-9０-９]{{3}}[^0-9０-９]')))
      or (start > 0 and b1 = '.' and regexp_matches(b2, '[0-9０-９]')) or (a1 = '.' and regexp_matches(substr(a4, 1, 1), '[0-9０-９]')))),
    gaps as (select *, case when regexp_full_match(substr(text, lag("end") over w + 1, start - lag("end") over w), '[-－ 、]|[)）] ?|[)）]-|-?\\r?\\n') then 0 else 1 end as new from kept window w as (partition by doc_id order by start)),
    chains as (select *, sum(new) over (partition by doc_id order by start) as island from gaps),
    ends as (select *, max(i) over (partition by doc_id, island) as j from chains),
    pairs as (select distinct a.doc_id, a.start, b."end" from ends a join ends b on a.doc_id = b.doc_id and a.island = b.island and b.i >= a.i and (b.i <= a.i + 5 or b.i = a.j)
      where (select sum(c."end" - c.start) from ends c where c.doc_id = a.doc_id and c.i between a.i and b.i) >= 3),
    told as (select p.*, d.text, length(regexp_extract(substr(d.text, p."end" + 1, 12), '^\\s?(?:#|轉|分機|ext\\.?)\\s?[0-9０-９]{{1,5}}')) as more from pairs p join documents d using (doc_id)),
    ranges as (select doc_id, unnest(case when start > 0 and substr(text, start, 1) in ('+', '(', '（', '#') then [start, start - 1] else [start] end) as start, "end", more, text from told),
    forms as (select doc_id, start, unnest(list_distinct([cast("end" as int), cast("end" + more as int), cast("end" + case when substr(text, "end" + 1, 1) = '#' then 1 else 0 end as int)])) as "end" from ranges),
    whole as (select e.doc_id, min(e.start) as s, max(e."end") as t, sum(e."end" - e.start) as n, any_value(e.text) as text from ends e group by e.doc_id, e.island),
    spelled as (select doc_id, s, t, length(regexp_extract(substr(text, greatest(s - 4, 0) + 1, s - greatest(s - 4, 0)), '(?:[A-Z] ){{1,2}}$')) as lead from whole where n >= 6)
    select distinct doc_id, cast(start as int) as start, "end" from forms union select doc_id, cast(s - lead as int), cast(t as int) from spelled where lead > 0"""


@query(NUMBERS)
def scan_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.number_chains(docs_of(spark, sf_dir))


@query(
    f"""with runs as ({sql_spans("documents", "doc_id", "text", "[0-9]{4}(?:[ -]?[0-9]{4}){3}")}),
    d as (select doc_id, start, regexp_replace(value, '[^0-9]', '', 'g') as digits from runs),
    n as (select *, list_sum(list_transform(range(1, 17), lambda i: case when (16 - i) % 2 = 1 then case when cast(digits[i] as int) > 4 then cast(digits[i] as int) * 2 - 9 else cast(digits[i] as int) * 2 end else cast(digits[i] as int) end)) as total from d)
    select doc_id, start, digits, total % 10 = 0 as ok from n"""
)
def check_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.spans import match_spans

    found = docs_of(spark, sf_dir).select("doc_id", F.explode(match_spans(F.col("text"), "[0-9]{4}(?:[ -]?[0-9]{4}){3}")).alias("s"))
    return found.select("doc_id", "s.start", V.digits(F.col("s.value")).alias("digits")).withColumn("ok", V.luhn_ok(F.col("digits")))


@query(
    """with d as (select s_suppkey, lpad(cast(s_suppkey * 104729 % 100000000 as varchar), 8, '0') as ubn from supplier),
    n as (select *, list_sum(list_transform([1,2,3,4,5,6,7,8], lambda i: (cast(ubn[i] as int) * [1,2,1,2,1,2,4,1][i]) // 10 + (cast(ubn[i] as int) * [1,2,1,2,1,2,4,1][i]) % 10)) as t from d)
    select s_suppkey, ubn, (t % 5 = 0) or (ubn[7] = '7' and (t + 1) % 5 = 0) as ok from n"""
)
def check_business_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.lpad((F.col("s_suppkey") * 104729 % 100000000).cast("string"), 8, "0").alias("ubn"))
    return s.withColumn("ok", V.ubn_ok(F.col("ubn")))


ID_SQL = """with d as (select c_custkey, substr('ABCDEFGHJKLMNPQRSTUVXYWZIO', cast(c_custkey % 26 + 1 as int), 1) as l, cast(c_custkey % 26 + 10 as int) as n,
      concat(cast(c_custkey % 2 + 1 as varchar), lpad(cast(c_custkey * 7919 % 10000000 as varchar), 7, '0')) as b from customer),
    c as (select *, n // 10 + n % 10 * 9 + list_sum(list_transform([1,2,3,4,5,6,7,8], lambda i: cast(b[i] as int) * (9 - i))) as t from d)
    select c_custkey, l || b || cast((10 - t % 10) % 10 as varchar) as id, true as ok, l || b || cast((11 - t % 10) % 10 as varchar) as wrong, false as wrong_ok from c"""


@query(ID_SQL)
def make_national_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    letter = F.substring(F.lit(P.ID_LETTERS), (F.col("c_custkey") % 26 + 1).cast("int"), F.lit(1))
    body = F.concat((F.col("c_custkey") % 2 + 1).cast("string"), F.lpad((F.col("c_custkey") * 7919 % 10000000).cast("string"), 7, "0"))
    d = c.select("c_custkey", letter.alias("l"), body.alias("b")).withColumn("k", V.id_check_digit(F.col("l"), F.col("b")))
    made = d.select("c_custkey", F.concat("l", "b", F.col("k").cast("string")).alias("id"), F.concat("l", "b", ((F.col("k") + 1) % 10).cast("string")).alias("wrong"))
    return made.select("c_custkey", "id", V.id_ok(F.col("id")).alias("ok"), "wrong", V.id_ok(F.col("wrong")).alias("wrong_ok"))


TILES = """with d as (select doc_id, length(text) as n from documents),
    s as (select doc_id, n, unnest(range(0, cast(case when n <= 220 then 0 else ceil((n - 220) / 160.0) * 160 end as bigint) + 1, 160)) as ws from d)
    select doc_id, cast(ws as int) as ws, cast(least(ws + 220, n) as int) as we, cast(case when ws = 0 then 0 else ws + 30 end as int) as core_s, cast(case when ws + 220 >= n then n else ws + 190 end as int) as core_e from s"""


@query(TILES)
def tile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tiles(docs_of(spark, sf_dir))


@query(
    f"""select e.doc_id, e.start, e."end", e.value, t.ws, t.we from ({EMAILS}) e join ({TILES}) t on e.doc_id = t.doc_id
    and t.ws <= e.start and e."end" <= t.we and t.core_s <= (e.start + e."end") / 2.0 and (e.start + e."end") / 2.0 < t.core_e"""
)
def tile_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.assigned(email_rows(spark, sf_dir), docs_of(spark, sf_dir))


_LONG_RUN = "[!-~]+(?: [!-~]+){9,14}"


def _tiles_keeping_sql() -> str:
    """Tile by tile: each ends TILE on, or OVERLAP behind the first kept run that it would cut and that the next one would not hold."""
    def end(s: str) -> str:
        return f"case when {s} + {P.TILE} >= len then len else coalesce(min(k.start) + {P.OVERLAP}, {s} + {P.TILE}) end"

    def cuts(s: str) -> str:
        return f"k.doc_id = d.doc_id and k.start > {s} and k.start + {P.OVERLAP} < {s} + {P.TILE} and k.stop > {s} + {P.TILE}"

    runs = sql_spans("documents", "doc_id", "text", _LONG_RUN)
    return f"""with recursive r as ({runs}), k as (select doc_id, start, "end" as stop from r where "end" - start > {P.OVERLAP} and "end" - start <= {P.TILE}),
    n as (select doc_id, length(text) as len from documents where text is not null),
    w as (select d.doc_id, len, cast(0 as bigint) as ws, cast({end("0")} as bigint) as we from n d left join k on {cuts("0")} group by d.doc_id, len
        union all select d.doc_id, len, d.we - {P.OVERLAP}, {end(f"(d.we - {P.OVERLAP})")} from w d left join k on {cuts(f"(d.we - {P.OVERLAP})")} where d.we < len group by d.doc_id, len, d.we)
    select doc_id, cast(ws as int) as ws, cast(we as int) as we, cast(case when ws = 0 then 0 else ws + {P.OVERLAP // 2} end as int) as core_s, cast(case when we = len then len else we - {P.OVERLAP // 2} end as int) as core_e from w"""


@query(_tiles_keeping_sql())
def tile_keeping_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of whole documents that keep their long ASCII runs whole."""
    from ..functions.spans import match_spans

    return tiles.tiles_keeping(docs_of(spark, sf_dir), match_spans(F.col("text"), _LONG_RUN))


def scored(spans: DataFrame) -> DataFrame:
    """Probabilities from places, in place of a model: any scorer that gives p_mask and p_keep fits here."""
    h = (F.col("start").cast("long") * 7919 + F.col("end").cast("long") * 104729 + F.col("doc_id").cast("long") * 31) % 997
    return spans.withColumns({"p_mask": (h / 997.0), "p_keep": ((996 - h) / 1994.0)})


@query(
    f"""with recursive n as ({NUMBERS}), s as (select *, ((start::bigint * 7919 + "end"::bigint * 104729 + doc_id::bigint * 31) % 997) as h from n),
    p as (select *, h / 997.0::double as pm, (996 - h) / 1994.0::double as pk from s),
    o as (select *, row_number() over (partition by doc_id order by -(pm + pk), start, "end") as k from p where pm + pk >= 0.6),
    r(doc_id, k, chosen) as (
      select doc_id, 0::bigint, []::struct(s int, e int, pm double, pk double)[] from (select distinct doc_id from o)
      union all
      select r.doc_id, o.k, case when len(list_filter(r.chosen, lambda c: c.s < o."end" and o.start < c.e)) > 0 then r.chosen else list_append(r.chosen, {{'s': o.start, 'e': o."end", 'pm': o.pm, 'pk': o.pk}}) end
      from r join o on o.doc_id = r.doc_id and o.k = r.k + 1),
    last as (select doc_id, max_by(chosen, k) as chosen from r group by doc_id), u as (select doc_id, unnest(chosen) as c from last)
    select doc_id, c.s as start, c.e as "end", 'NUMBER' as type, round(c.pm + c.pk, 3) as score, round(c.pm, 3) as p_mask, 'num' as kind from u"""
)
def decode_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = C.number_chains(docs_of(spark, sf_dir)).withColumn("kind", F.lit("num"))
    return decode.selected(scored(spans), tau=0.6)


@query(
    f"""with e as ({EMAILS}), f as (select doc_id, value, min(start) as pos from e group by doc_id, value),
    r as (select doc_id, value, row_number() over (partition by doc_id order by pos, value) as n from f)
    select e.doc_id, e.start, e."end", e.value, concat('〔Email', r.n, '〕') as new from e join r using (doc_id, value)"""
)
def code_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = email_rows(spark, sf_dir).withColumn("type", F.lit("EMAIL"))
    return rewrite.coded(spans, ["doc_id"], ["start"]).select("doc_id", "start", "end", "value", "new")


def emails_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = email_rows(spark, sf_dir).withColumn("type", F.lit("EMAIL"))
    return rewrite.rewritten(docs_of(spark, sf_dir), rewrite.coded(spans, ["doc_id"], ["start"]))


@query(
    f"""with marked as (select doc_id, string_split(regexp_replace(text, '({EMAIL_SQL})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) as p from documents),
    parts as (select doc_id, unnest(p) as part, generate_subscripts(p, 1) as i from marked),
    v as (select doc_id, i, part, case when i > 1 then split_part(part, chr(2), 1) end as value from parts),
    f as (select doc_id, value, min(i) as pos from v where i > 1 group by doc_id, value),
    r as (select doc_id, value, row_number() over (partition by doc_id order by pos) as n from f)
    select v.doc_id, string_agg(case when v.i = 1 then part else concat('〔Email', r.n, '〕', substr(part, length(v.value) + 2)) end, '' order by v.i) as rewritten
    from v left join r on v.doc_id = r.doc_id and v.value = r.value group by v.doc_id"""
)
def rewrite_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emails_rewritten(spark, sf_dir).select("doc_id", "rewritten")


@query("select doc_id, text as back from documents")
def restore_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = emails_rewritten(spark, sf_dir)
    return r.select("doc_id", decode.restored(F.col("rewritten"), F.col("log")).alias("back"))


@query(
    f"""with e as (select *, case when (doc_id + start) % 3 = 0 then 'MASK' else 'KEEP' end as label from ({EMAILS}))
    select doc_id, start, "end", value, label, case when exists (select 1 from e x where x.doc_id // 10 = e.doc_id // 10 and x.value = e.value and x.label = 'MASK') then 'MASK' else label end as final from e"""
)
def mask_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = email_rows(spark, sf_dir).withColumns({"label": F.when((F.col("doc_id") + F.col("start")) % 3 == 0, "MASK").otherwise("KEEP"), "scope": F.floor(F.col("doc_id") / 10)})
    return consistency.masked_everywhere(spans, ["scope"]).drop("scope")


@query(
    f"""with w as (select doc_id, unnest(string_split(lower(text), ' ')) as word from documents), e as (select distinct value from ({EMAILS}))
    select * from (select word, count(distinct doc_id) as docs from w where word <> '' group by word having count(distinct doc_id) >= 20) f where not exists (select 1 from e where contains(e.value, f.word) or contains(f.word, e.value))"""
)
def known_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = docs_of(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("word")).where("word <> ''")
    return consistency.known_negatives(words, email_rows(spark, sf_dir))


# Case files.

TAGGED = ["P", "DATE", "TEL", "MAIL", "ID"]
YMD = f"{casefiles.Y} as yy, {casefiles.M} as mm, {casefiles.D} as dd"


@query(
    f"""select o_orderkey as doc_id, {casefiles.DATE} as value, case when o_orderkey % 5 in (0, 2) then yy - 1911 else yy end as y, mm as m, dd as d,
    case when o_orderkey % 5 = 3 then cast(yy as varchar) when o_orderkey % 5 = 0 then concat('民國', yy - 1911, '年') when o_orderkey % 5 = 2 then concat(yy - 1911, '年') else concat(yy, '年') end as by_year,
    case when o_orderkey % 5 = 3 then concat(['January','February','March','April','May','June','July','August','September','October','November','December'][mm], ' ', yy)
      when o_orderkey % 5 = 0 then concat('民國', yy - 1911, '年', mm, '月') when o_orderkey % 5 = 2 then concat(yy - 1911, '年', mm, '月') else concat(yy, '年', mm, '月') end as by_month
    from (select *, {YMD} from orders)"""
)
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as doc_id", f"{casefiles.DATE} as value")
    p = d.withColumn("p", V.parse_date(F.col("value")))
    return p.select("doc_id", "value", "p.y", "p.m", "p.d", V.coarse_date(F.col("value"), "year").alias("by_year"), V.coarse_date(F.col("value"), "month").alias("by_month"))


@query(casefiles.gold_sql([*TAGGED, "ADDR", "ORG"]).replace("select doc_id, case_id, ", "select doc_id, "))
def parse_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked.parsed(casefiles.marked(spark, sf_dir)).select("doc_id", "start", "end", "tag", "value")


def case_spans(spark: SparkSession, sf_dir: str, tags: list[str] = TAGGED) -> DataFrame:
    """Spans as a detector gives them: the tagged values, typed."""
    g = casefiles.gold(spark, sf_dir, tags)
    kinds = {"P": "PERSON", "DATE": "DATE_EVENT", "TEL": "NUMBER", "MAIL": "EMAIL", "ID": "NUMBER"}
    return g.withColumn("type", F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("tag")])


CODED = f"""with g as ({casefiles.gold_sql(["P"])}), f as (select case_id, value, min({{'d': doc_id, 's': start}}) as pos from g group by all),
    r as (select case_id, value, row_number() over (partition by case_id order by pos, value) as n from f)
    select g.doc_id, g.case_id, g.value as name, concat(substr('甲乙丙丁戊庚壬癸', cast((n - 1) % 8 + 1 as int), 1), case when n > 8 then cast((n - 1) // 8 + 1 as varchar) else '' end) as code from g join r using (case_id, value)"""


@query(CODED)
def code_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = case_spans(spark, sf_dir, ["P"])
    return rewrite.coded(spans, ["case_id"], ["doc_id", "start"]).select("doc_id", "case_id", F.col("value").alias("name"), F.col("new").alias("code"))


@query(CODED)
def stream_case_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same codes from a stream of documents in order, the state of each case carried along."""
    from ..streaming.case_codes import coded_stream

    base = shared_path(spark, "stream")
    mentions = case_spans(spark, sf_dir, ["P"]).select("case_id", "doc_id", "start", F.col("value").alias("name"))
    mentions.write.parquet(f"{base}/in")
    stream = spark.readStream.schema("case_id long, doc_id long, start int, name string").parquet(f"{base}/in")
    run = coded_stream(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema("case_id long, doc_id long, name string, code string").parquet(f"{base}/out").select("doc_id", "case_id", "name", "code")


_MONTH_SQL = "case when o_orderkey % 5 = 3 then concat(['January','February','March','April','May','June','July','August','September','October','November','December'][mm], ' ', yy) when o_orderkey % 5 = 0 then concat('民國', yy - 1911, '年', mm, '月') when o_orderkey % 5 = 2 then concat(yy - 1911, '年', mm, '月') else concat(yy, '年', mm, '月') end"


def replaced_text(parts: dict[str, str]) -> str:
    """The text of the case files with some of its tagged parts as other SQL."""
    return "concat(" + ", ".join(parts.get(t, p) if t else p for t, p in casefiles.PARTS) + ")"


ANONYMIZED = f"""with c as ({CODED}) select o_orderkey as doc_id, {replaced_text({"P": "c.code", "DATE": _MONTH_SQL, "TEL": "'〔電話1〕'", "MAIL": "'〔Email1〕'", "ID": "'〔號碼1〕'"})} as text
    from (select *, {YMD} from orders) o join c on c.doc_id = o.o_orderkey"""


@query(ANONYMIZED)
def anonymize_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = casefiles.documents(spark, sf_dir)
    return rewrite.anonymized(docs, case_spans(spark, sf_dir), ["case_id"], ["doc_id", "start"])


@query(f"select o_orderkey as doc_id, {casefiles.TEXT} as restored from orders where o_orderkey % 5 <> 9")
def restore_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded texts go out, come back as replies, and are restored through the mapping of their case."""
    docs = casefiles.documents(spark, sf_dir)
    # Written, as texts and mapping both read the codes.
    spans = kept(rewrite.coded(case_spans(spark, sf_dir).where("type <> 'DATE_EVENT'"), ["case_id"], ["doc_id", "start"]), "codes")
    sent = rewrite.rewritten(docs, spans).select("doc_id", "case_id", F.col("rewritten").alias("text"))
    table = rewrite.mapping(spans, ["case_id"])
    return rewrite.restored_by_mapping(sent, table, ["case_id"], "doc_id").select("doc_id", "restored")


@query()
def pseudonymize_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = case_spans(spark, sf_dir, ["TEL", "MAIL", "ID"])
    return realistic.pseudonyms(spans, ["case_id"], "salt", V.keep_head(F.col("value"))).select("doc_id", "case_id", "type", "value", "new")


PEOPLE = casefiles.gold_sql(["P"])


@query(f"with g as ({PEOPLE}) select distinct case_id, substr(value, 1, 1) as surname, true as other, true as one_to_one from g")
def pseudonymize_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each surname of a nation has another; no two of it share one, though a nation has hundreds of people."""
    names_of = case_spans(spark, sf_dir, ["P"]).select("case_id", F.substring("value", 1, 1).alias("surname"))
    m = realistic.surname_map(names_of, ["case_id"], "salt")
    shared = F.count("*").over(Window.partitionBy("case_id", "fake")) == 1
    return m.select("case_id", "surname", (F.col("fake") != F.col("surname")).alias("other"), shared.alias("one_to_one"))


def checked_stand_ins(made: DataFrame, scope: str) -> DataFrame:
    """Distinct values of a scope, and whether each has one stand-in that is no other value's and not itself."""
    each = made.groupBy(scope, "value").agg(F.countDistinct("new").alias("n"), F.min("new").alias("new"))
    alone = F.count("*").over(Window.partitionBy(scope, "new")) == 1
    return each.select(scope, "value", ((F.col("n") == 1) & alone & (F.col("new") != F.col("value"))).alias("ok"), "new")


@query(f"with g as ({PEOPLE}) select distinct case_id % 25 as region, value, true as ok, true as same_shape from g")
def pseudonymize_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a region of many cases: one stand-in for each, of the same length, no two alike."""
    spans = case_spans(spark, sf_dir, ["P"]).select("doc_id", (F.col("case_id") % 25).alias("region"), "start", "end", "value", F.lit("full").alias("kind"))
    out = checked_stand_ins(realistic.persons(spans, ["region"], "salt"), "region")
    return out.select("region", "value", "ok", (F.length("new") == F.length("value")).alias("same_shape"))


@query(f"""with g as ({casefiles.gold_sql(["ORG"])}) select distinct case_id % 25 as region, value, true as ok, true as same_form from g""")
def pseudonymize_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations of a region: another brand for each, the form kept, no two alike."""
    spans = casefiles.gold(spark, sf_dir, ["ORG"]).select((F.col("case_id") % 25).alias("region"), "value")
    out = checked_stand_ins(realistic.organisations(spans, ["region"], "salt"), "region")
    return out.select("region", "value", "ok", ((F.length("new") == F.length("value")) & (F.substring("new", 3, 10) == F.substring("value", 3, 10))).alias("same_form"))


@query(f"""with g as ({casefiles.gold_sql(["ADDR"])}) select doc_id, value, regexp_extract(value, '^[^區]+區') as head, regexp_extract(value, '[0-9]+樓$') as floor, true as other from g""")
def pseudonymize_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses keep city, district and floor; road and house are others."""
    spans = casefiles.gold(spark, sf_dir, ["ADDR"])
    out = realistic.addresses(spans, ["case_id"], "salt")
    road = lambda c: F.regexp_extract(c, "區(.*?)(?:路|街)", 1)
    return out.select("doc_id", "value", F.regexp_extract("new", "^[^區]+區", 0).alias("head"), F.regexp_extract("new", "[0-9]+樓$", 0).alias("floor"), (road("new") != road("value")).alias("other"))


@query(
    f"""select doc_id, value, cast(case when d like '886%' then least(4, greatest(length(d) - 4, 0)) when length(d) - length(ltrim(d, '0')) >= 2 then least(length(d) - length(ltrim(d, '0')), greatest(length(d) - 4, 0))
      when regexp_matches(d, '^0[2-9]') then least(2, greatest(length(d) - 4, 0)) else 0 end as int) as keep from (select doc_id, value, value as d from ({casefiles.gold_sql(["TEL", "ID"])}))"""
)
def number_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return casefiles.gold(spark, sf_dir, ["TEL", "ID"]).select("doc_id", "value", V.keep_head(F.col("value")).alias("keep"))


PREDICTED_SQL = """select doc_id, case when (doc_id + start) % 7 = 0 then start + 1 else start end as start, "end", tag as type from g where (doc_id + start) % 5 <> 0"""


def predicted(gold: DataFrame) -> DataFrame:
    """Predictions that miss a fifth of the values and the first character of a seventh."""
    at = F.col("doc_id") + F.col("start")
    return gold.where(at % 5 != 0).select("doc_id", F.when(at % 7 == 0, F.col("start") + 1).otherwise(F.col("start")).cast("int").alias("start"), "end", F.col("tag").alias("type"))


@query(
    f"""with g as ({casefiles.gold_sql(TAGGED)}), p as ({PREDICTED_SQL}),
    c as (select g.tag as label, coalesce(p.start <= g.start, false) as "full", coalesce(p.start > g.start, false) as "partial", coalesce(p.start = g.start, false) as "exact" from g left join p on p.doc_id = g.doc_id and p.start < g."end" and g.start < p."end")
    select label, count(*) as n, cast(sum(cast("full" as int)) as bigint) as "full", cast(sum(cast("partial" as int)) as bigint) as "partial", cast(sum(cast("exact" as int)) as bigint) as "exact" from c group by rollup(label)"""
)
def recall_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = casefiles.gold(spark, sf_dir, TAGGED)
    return evaluate.recall_by_label(gold.withColumn("label", F.col("tag")), predicted(gold))


@query(
    f"""with g as ({casefiles.gold_sql(TAGGED)}), p as ({PREDICTED_SQL}), h as (select * from g where tag <> 'ID')
    select type, count(*) as n, cast(sum(case when exists (select 1 from h where h.doc_id = p.doc_id and h.start < p."end" and p.start < h."end") then 1 else 0 end) as bigint) as hits from p group by rollup(type)"""
)
def precision_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = casefiles.gold(spark, sf_dir, TAGGED)
    return evaluate.precision_by_type(gold.where("tag <> 'ID'"), predicted(gold))


@query(
    f"""with g as ({casefiles.gold_sql(["TEL", "MAIL", "ID"])}), t as ({ANONYMIZED}),
    o as (select g.*, regexp_replace(regexp_replace(t.text, '〔[^〕]*〕', '', 'g'), '[^0-9A-Za-z]', '', 'g') as rest, t.text, regexp_replace(g.value, '[^0-9A-Za-z]', '', 'g') as bare from g join t using (doc_id) where doc_id % 4 <> 0 or tag <> 'TEL'
      union all select g.*, regexp_replace(regexp_replace(d.text, '〔[^〕]*〕', '', 'g'), '[^0-9A-Za-z]', '', 'g'), d.text, regexp_replace(g.value, '[^0-9A-Za-z]', '', 'g') from g join ({casefiles.DOCS_SQL}) d using (doc_id) where g.doc_id % 4 = 0 and tag = 'TEL')
    select tag as label, count(*) as n, cast(sum(cast(contains(text, value) as int)) as bigint) as whole,
      cast(sum(cast(contains(text, value) or len(list_filter(range(1, length(bare) - 2), lambda i: contains(rest, substr(bare, cast(i as int), 4)))) > 0 as int)) as bigint) as any_part from o group by tag"""
)
def residual_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the values is left in the texts that are put out, where a quarter of the phones was missed."""
    docs = casefiles.documents(spark, sf_dir)
    out = anonymize_cases(spark, sf_dir).withColumnRenamed("text", "o").join(unsent(docs), "doc_id")
    gold = casefiles.gold(spark, sf_dir, ["TEL", "MAIL", "ID"]).withColumn("label", F.col("tag"))
    missed = (F.col("doc_id") % 4 == 0) & (F.col("tag") == "TEL")
    done = evaluate.leak_flags(gold.where(~missed), out.select("doc_id", F.col("o").alias("text"))).unionByName(evaluate.leak_flags(gold.where(missed), out.select("doc_id", "text")))
    return evaluate.leak_counts(done)


PLANTED = f"""with g as ({{gold}}) select doc_id, start, "end", value, true as found from g"""


def found_in(spark: SparkSession, sf_dir: str, tag: str, spans: Column) -> DataFrame:
    """The planted values of a tag, and whether the generator has each of them exactly."""
    gold = casefiles.gold(spark, sf_dir, [tag]).select("doc_id", "start", "end", "value")
    got = C.exploded(casefiles.documents(spark, sf_dir), "doc_id", spans).select("doc_id", "start", "end", F.lit(True).alias("found")).distinct()
    return gold.join(unsent(got), ["doc_id", "start", "end"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


@query(PLANTED.format(gold=casefiles.gold_sql(["P"]).replace("select doc_id, case_id, ", "select doc_id, ")))
def scan_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_in(spark, sf_dir, "P", names.persons(F.col("text")))


@query(PLANTED.format(gold=casefiles.gold_sql(["ADDR"]).replace("select doc_id, case_id, ", "select doc_id, ")))
def scan_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_in(spark, sf_dir, "ADDR", addresses.addresses(F.col("text")))


@query(PLANTED.format(gold=casefiles.gold_sql(["ORG"]).replace("select doc_id, case_id, ", "select doc_id, ")))
def scan_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_in(spark, sf_dir, "ORG", organisations.organisations(F.col("text")))


@query()
def scan_document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and organisation candidates of whole documents."""
    return C.exploded(docs_of(spark, sf_dir), "doc_id", F.concat(names.persons(F.col("text")), organisations.organisations(F.col("text"))))


#: Case files without the parts in which a letter beside a digit looks like one (mail7, April 5).
PLAIN = replaced_text({"DATE": "''", "MAIL": "''"})


@query(f"select o_orderkey as doc_id, {PLAIN} as clean from orders")
def normalize_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case files as a scanner gives them, with blanks and junk in phones, full-width digits and look-alikes, are what they were."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as doc_id", f"{PLAIN} as text", f"{casefiles.PHONE} as phone")
    noisy = F.concat(F.translate(F.substring("phone", 1, 3), "01", "O1"), F.lit(" "), F.translate(F.substring("phone", 4, 3), "0123456789", "０１２３４５６７８９"), F.lit("^\n"), F.substring("phone", 7, 4))
    scanned = orders.select("doc_id", F.replace("text", F.col("phone"), F.regexp_replace(noisy, "^O", "0")).alias("text"))
    return tolerant.normalized(scanned).select("doc_id", "clean")


@query("select doc_id, lang, n_chars from documents where n_chars >= 800")
def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars >= 800").select("doc_id", "lang", "n_chars")


#: DuckDB: crc32 of a text of ASCII characters, by a table that the polynomial gives.
CRC_TABLE = "select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)"


def sql_crc32(text: str, table: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: cast(ascii(x) as bigint))), lambda c, x: xor(c >> 8, {table}[xor(c & 255, x) + 1])), 4294967295)"


@query(f"with k as ({CRC_TABLE}), c as (select doc_id, {sql_crc32('cast(doc_id as varchar)', 'k.t')} as crc from documents, k) select doc_id, case when crc % 10 = 0 then 'dev' else 'train' end as part, cast(crc % 2 as int) as half from c")
def split_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth for development, halves for tests, by crc32 of the id."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return docs_of(spark, sf_dir).select("doc_id", F.when(crc % 10 == 0, "dev").otherwise("train").alias("part"), (crc % 2).cast("int").alias("half"))


@query(f"""with e as ({EMAILS}) select distinct upper(e.value) as canon, count(distinct doc_id) as docs from e group by value order by docs desc, canon limit 8""")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = email_rows(spark, sf_dir).withColumn("canon", F.upper(V.canon(F.col("value"))))
    return found.groupBy("canon").agg(F.countDistinct("doc_id").alias("docs")).orderBy(F.desc("docs"), "canon").limit(8)


_SHIFT = "cast((o_custkey % 40 - 20) * 7 as int)"
_SHIFTED = f"(o_orderdate::date + {_SHIFT})"


def _shifted_sql() -> str:
    """The date expression of the case files over the shifted date."""
    return f"select doc_id, {casefiles.DATE} as value from (select o_orderkey as doc_id, o_orderkey, o_custkey, {_SHIFTED} as o_orderdate from orders)"


@query(_shifted_sql())
def shift_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case's dates move by its own number of weeks, in the notation they have."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey as doc_id", "o_custkey", f"{casefiles.DATE} as value")
    days = ((F.col("o_custkey") % 40 - 20) * 7).cast("int")
    return orders.select("doc_id", V.shifted_date(F.col("value"), days).alias("value"))


@query(
    f"""with g as ({casefiles.gold_sql(["P", "TEL", "MAIL"])}),
    c as (select doc_id, start, "end", case when tag = 'P' then 'person' else 'pii' end as grp, tag from g
      union all select doc_id, start + 1, "end", 'pii', tag from g where tag = 'TEL' union all select doc_id, 0, 1, 'person', 'x' from g where tag = 'P' union all select doc_id, 0, 1, 'pii', 'x' from g where tag = 'P')
    select doc_id, cast(start as int) as start, "end", grp, case when tag in ('P', 'TEL', 'MAIL') and start in (select g.start from g where g.doc_id = c.doc_id) then 'MASK' when tag = 'TEL' or grp = 'person' then 'NOT' end as label from c"""
)
def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.labelling import labelled

    gold = casefiles.gold(spark, sf_dir, ["P", "TEL", "MAIL"])
    ann = gold.select("doc_id", "start", "end", F.when(F.col("tag") == "P", "person").otherwise("pii").alias("grp"), F.lit("MASK").alias("label"))
    shifted = gold.where("tag = 'TEL'").select("doc_id", (F.col("start") + 1).alias("start"), "end", F.lit("pii").alias("grp"))
    heads = gold.where("tag = 'P'").select("doc_id", F.lit(0).alias("start"), F.lit(1).alias("end"), F.explode(F.array(F.lit("person"), F.lit("pii"))).alias("grp"))
    cand = ann.drop("label").unionByName(shifted).unionByName(heads)
    return labelled(cand, ann, gold.select("doc_id", F.lit("person").alias("grp")))


@query("select o_orderkey as doc_id, 'Email1,號碼1,電話1' as codes from orders")
def used_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that anonymized texts hold, which a later document of the case must not reuse."""
    from ..operators.labelling import used_codes as codes

    # English months begin with capitals, but none stands alone.
    return anonymize_cases(spark, sf_dir).select("doc_id", F.array_join(codes(F.col("text")), ",").alias("codes"))


@query(
    f"""with g as ({casefiles.gold_sql(["P", "TEL"])}), m as (select * from g where doc_id % 3 = 0)
    select g.doc_id, g.start, g."end", g.value from g where g.doc_id % 3 <> 0 and exists (select 1 from m where m.case_id = g.case_id and m.value = g.value)"""
)
def other_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values masked in one document of a case, wherever else the case holds them."""
    gold = casefiles.gold(spark, sf_dir, ["P", "TEL"])
    return consistency.other_mentions(gold.where("doc_id % 3 = 0"), gold, "case_id").select("doc_id", "start", "end", "value")


@query("select p_partkey, p_name, split_part(p_name, ' ', 1) as short from part")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up by their longest listed prefix."""
    from ..operators.labelling import short_names as look_up

    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    first = F.substring_index("p_name", " ", 1)
    table = parts.select(first.alias("full"), first.alias("short")).where(F.length("full") >= 2).distinct()
    named = look_up(parts.select(F.col("p_name").alias("name")).distinct(), table)
    return parts.join(named, parts["p_name"] == named["name"]).select("p_partkey", "p_name", "short")


@query("select conv_id, turn, text, role from conversations")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations out as JSON lines and back with a declared schema."""
    from ..sources.files import read_json_lines

    to = shared_path(spark, "json")
    spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").write.json(to)
    return read_json_lines(spark, to, "conv_id long, turn long, role string, text string").where("bad is null").drop("bad")


@query()
def detect_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine with the rule scorer: candidates of all kinds, scored, selected."""
    return engine(spark).detect(casefiles.documents(spark, sf_dir))


@query()
def pseudonymize_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = engine(spark).pseudonymized(casefiles.documents(spark, sf_dir), "case_id", "salt")
    return out.select("doc_id", F.col("rewritten").alias("text"))


def length_model():
    """A model small enough to write as SQL: digits speak for masking, letters for neither."""
    import numpy as np

    def model(values, kinds, around):
        digits = np.array([sum(c in "0123456789" for c in v) for v in values], float)
        n = np.array([len(v) for v in values], float)
        return np.c_[digits / 2, np.where(np.array(kinds) == "email", 1.0, 0.0), (n - digits) / 4]

    return model


@query(
    f"""with e as ({EMAILS}), z as (select *, length(regexp_replace(value, '[^0-9]', '', 'g')) as d, length(value) as n from e),
    l as (select *, exp(d / 2.0) as a, exp(1.0) as b, exp((n - d) / 4.0) as c from z)
    select doc_id, start, "end", 'email' as kind, value, cast(round(1e6 * a / (a + b + c)) as bigint) as mask_ppm, cast(round(1e6 * b / (a + b + c)) as bigint) as keep_ppm from l"""
)
def score_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.score import scored as by_model

    spans = email_rows(spark, sf_dir).withColumn("kind", F.lit("email"))
    p = by_model(spans, docs_of(spark, sf_dir), length_model)
    return p.select("doc_id", "start", "end", "kind", "value", F.round(F.col("p_mask") * 1e6).cast("long").alias("mask_ppm"), F.round(F.col("p_keep") * 1e6).cast("long").alias("keep_ppm"))


@query(casefiles.gold_sql(["P"]).replace("select doc_id, case_id, P_start", "select doc_id, P_start"))
def uncovered_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated values that no candidate of the pattern generators is exactly: here the names, for which there are scanners."""
    docs = casefiles.documents(spark, sf_dir)
    found = C.structured(docs).select("doc_id", "start", "end").unionByName(C.number_chains(docs)).distinct()
    return casefiles.gold(spark, sf_dir, TAGGED).join(unsent(found), ["doc_id", "start", "end"], "left_anti").select("doc_id", "start", "end", "tag", "value")


@query(
    f"""with g as ({casefiles.gold_sql(TAGGED)}), p as ({PREDICTED_SQL}),
    c as (select g.doc_id, g.tag, coalesce(p.start <= g.start, false) as hit from g left join p on p.doc_id = g.doc_id and p.start < g."end" and g.start < p."end"),
    x as (select unnest(['ALL', concat('notation', doc_id % 5), concat('tag', tag)]) as phenomenon, hit from c)
    select phenomenon, count(*) as n, cast(sum(cast(hit as int)) as bigint) as hits from x group by phenomenon"""
)
def recall_by_phenomenon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value counts for each phenomenon that it shows, and for all."""
    gold = casefiles.gold(spark, sf_dir, TAGGED)
    covered = evaluate.gold_coverage(gold, predicted(gold))
    groups = F.array(F.lit("ALL"), F.concat(F.lit("notation"), (F.col("doc_id") % 5).cast("string")), F.concat(F.lit("tag"), F.col("tag")))
    return covered.select(F.explode(groups).alias("phenomenon"), "full").groupBy("phenomenon").agg(F.count("*").alias("n"), F.sum(F.col("full").cast("long")).alias("hits"))


@query(
    f"""with g as ({casefiles.gold_sql(["P"])}), r as (select concat(g.value, '#', g.case_id % 100) as name, o.o_orderstatus as role from g join orders o on o.o_orderkey = g.doc_id where o.o_orderstatus <> 'P')
    select name, min(role) as role, count(*) as n from r group by name having count(distinct role) = 1"""
)
def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that have one role only."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("role")).where("role <> 'P'")
    people = casefiles.gold(spark, sf_dir, ["P"]).join(orders, "doc_id").withColumn("name", F.concat("value", F.lit("#"), (F.col("case_id") % 100).cast("string")))
    return people.groupBy("name").agg(F.min("role").alias("role"), F.count("*").alias("n"), F.countDistinct("role").alias("d")).where("d = 1").drop("d")


@query(
    f"""with g as ({casefiles.gold_sql(TAGGED)}), p as (select *, case when (doc_id + start) % 11 = 0 then 'KEEP' when (doc_id + start) % 13 = 0 then 'NOT' else 'MASK' end as pred, case when tag = 'DATE' then 'KEEP' else 'MASK' end as label from g)
    select label, pred, count(*) as n from p group by label, pred"""
)
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("doc_id") + F.col("start")
    p = casefiles.gold(spark, sf_dir, TAGGED).select(F.when(F.col("tag") == "DATE", "KEEP").otherwise("MASK").alias("label"), F.when(at % 11 == 0, "KEEP").when(at % 13 == 0, "NOT").otherwise("MASK").alias("pred"))
    return p.groupBy("label", "pred").agg(F.count("*").alias("n"))


@query("select o_orderkey % 5 as notation, count(*) as n, cast(0 as bigint) as with_day from orders group by 1")
def generalized_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in the anonymized texts that still tell a day, by notation: none."""
    docs = casefiles.documents(spark, sf_dir)
    out = rewrite.rewritten(docs, rewrite.coded(case_spans(spark, sf_dir), ["case_id"], ["doc_id", "start"]))
    log = out.select("doc_id", "rewritten", F.explode("log").alias("s")).select("doc_id", "s.original", cut(F.col("rewritten"), F.col("s.start"), F.col("s.end")).alias("new"))
    dates = log.where(V.parse_date(F.col("original")).isNotNull() & F.col("original").rlike("[年/月,]"))
    day = F.col("new").rlike(r"[日號]|/|[0-9], ")
    return dates.groupBy((F.col("doc_id") % 5).alias("notation")).agg(F.count("*").alias("n"), F.sum(day.cast("long")).alias("with_day"))


@query()
def randomized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones and numbers of the marked texts with other digits in the same format."""
    rows = marked.parsed(casefiles.marked(spark, sf_dir)).where(F.col("tag").isin("TEL", "ID"))
    return rows.select("doc_id", "tag", "value", V.shaped(F.col("value"), F.concat_ws("|", "doc_id", "value")).alias("new"))


@query("select lang, source, count(*) as docs, cast(sum(length(text)) as bigint) as chars from documents group by rollup(lang, source)")
def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("select c_custkey, true as right_check, true as same_head, true as other from customer")
def fake_national_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for national ids: each has a right check digit, keeps its first two characters, and is another id."""
    from ..operators.fakes import fake_id

    made = make_national_ids(spark, sf_dir).select("c_custkey", "id")
    f = made.withColumn("f", fake_id(F.col("id"), F.concat(F.lit("salt"), "id")))
    return f.select("c_custkey", V.id_ok(F.col("f")).alias("right_check"), (F.substring("f", 1, 2) == F.substring("id", 1, 2)).alias("same_head"), (F.col("f") != F.col("id")).alias("other"))


@query("select distinct concat('c', cast(c_custkey as varchar), '@mail', cast(c_custkey % 97 as varchar), '.tw') as value, true as same_shape, true as top_level from customer")
def fake_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-ins for e-mails: same length, one @ and the same top level."""
    from ..operators.fakes import fake_email

    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey").cast("string")
    value = F.concat(F.lit("c"), key, F.lit("@mail"), (F.col("c_custkey") % 97).cast("string"), F.lit(".tw"))
    f = c.select(value.alias("value")).distinct().withColumn("f", fake_email(F.col("value"), F.concat(F.lit("salt"), F.col("value"))))
    return f.select("value", ((F.length("f") == F.length("value")) & F.col("f").rlike("^[a-z][0-9]+@[a-z]+[0-9]+")).alias("same_shape"), F.col("f").endswith(".tw").alias("top_level"))


@query()
def fake_page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fakes import fake_url

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", fake_url(F.col("url"), F.concat(F.lit("salt"), "url")).alias("fake"))


# Training text, and more evaluation.


def with_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return casefiles.documents(spark, sf_dir).select("doc_id", "text"), casefiles.gold(spark, sf_dir, [*TAGGED, "ADDR", "ORG"]).drop("case_id")


GOLD_VALUES = casefiles.gold_sql([*TAGGED, "ADDR", "ORG"])


@query(f"with x as ({GOLD_VALUES}) select doc_id, tag, value from x where tag <> 'P'")
def rename_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the case files exchanged for others: at the places that the other annotations moved to stand their values still."""
    docs, spans = with_spans(spark, sf_dir)
    texts, moved = augment.renamed(docs, spans, "salt")
    return augment.values_of(texts, moved).where("tag <> 'P'").select("doc_id", "tag", F.col("found").alias("value"))


@query(f"with x as ({GOLD_VALUES}) select doc_id, tag, value from x where tag <> 'ORG'")
def rebrand_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other brands in half of the documents; the other annotations keep their values."""
    docs, spans = with_spans(spark, sf_dir)
    texts, moved = augment.rebranded(docs, spans, "salt")
    return augment.values_of(texts, moved).where("tag <> 'ORG'").select("doc_id", "tag", F.col("found").alias("value"))


@query(f"with x as ({GOLD_VALUES}) select x.doc_id, x.tag, x.value, d.text as plain from x join ({casefiles.DOCS_SQL}) d using (doc_id)")
def mark_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup around values in three tenths of the documents: annotations stay on the values, and without the marks the text is what it was."""
    docs, spans = with_spans(spark, sf_dir)
    texts, moved = augment.marked_down(docs, spans, "salt")
    plain = texts.select("doc_id", F.replace("text", F.lit("**"), F.lit("")).alias("plain"))
    return augment.values_of(texts, moved).join(unsent(plain), "doc_id").select("doc_id", "tag", F.col("found").alias("value"), "plain")


@query(f"with x as ({GOLD_VALUES}) select doc_id, tag, value from x")
def add_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Junk as scanners leave it: without it, what stands at the moved places is the annotated value."""
    docs, spans = with_spans(spark, sf_dir)
    texts, moved = augment.noised(docs, spans, "salt")
    return augment.values_of(texts, moved).select("doc_id", "tag", F.translate("found", "".join(augment.NOISE), "").alias("value"))


@query(f"with g as ({PEOPLE}) select doc_id, start, \"end\", true as other from g")
def fill_masked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names masked as a court does are filled again, where they stood."""
    people = case_spans(spark, sf_dir, ["P"])
    masked = rewrite.rewritten(casefiles.documents(spark, sf_dir), people.withColumn("new", F.concat(F.substring("value", 1, 1), F.lit("○○"))))
    out = augment.filled(masked.select("doc_id", F.col("rewritten").alias("text")), "salt")
    each = out.select("doc_id", "text", F.explode("spans").alias("s"))
    return each.select("doc_id", "s.start", "s.end", (~cut(F.col("text"), F.col("s.start"), F.col("s.end")).contains("○")).alias("other"))


WRONG = """select p.*, case when g.doc_id is null then 'x' end as x from p left join (select distinct doc_id from h) g using (doc_id)
  where not exists (select 1 from h where h.doc_id = p.doc_id and h.start < p."end" and p.start < h."end")"""


@query(
    f"""with g as ({casefiles.gold_sql(TAGGED)}), p as (select doc_id, start, "end", tag as type, value from g), h as (select * from g where tag <> 'ID' and doc_id % 9 <> 0),
    w as ({WRONG}), n as (select *, row_number() over (partition by type, value order by doc_id, start) as k from w)
    select type, count(*) as spans, cast(sum("end" - start) as bigint) as chars, cast(sum(cast(k > 1 as int)) as bigint) as repeats, count(distinct case when x is not null then doc_id end) as negative_docs from n group by rollup(type)"""
)
def false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions where the gold standard has nothing: business numbers everywhere, and all values of a ninth of the documents."""
    gold = casefiles.gold(spark, sf_dir, TAGGED)
    return evaluate.false_positives(gold.where("tag <> 'ID' and doc_id % 9 <> 0"), gold.withColumnRenamed("tag", "type"))


@query(
    f"""with g as ({casefiles.gold_sql(TAGGED)}), p as ({PREDICTED_SQL}), h as (select * from g where tag <> 'ID'),
    c as (select g.tag, coalesce(p.start <= g.start, false) as hit from g left join p on p.doc_id = g.doc_id and p.start < g."end" and g.start < p."end"),
    r as (select tag as label, 100.0 * sum(cast(hit as int)) / count(*) as r from c group by tag),
    q as (select type as label, 100.0 * sum(case when exists (select 1 from h where h.doc_id = p.doc_id and h.start < p."end" and p.start < h."end") then 1 else 0 end) / count(*) as q from p group by type)
    select label, round(r::double, 1) as recall, round(q::double, 1) as precision, round(case when r + q > 0 then (2 * r * q / (r + q))::double end, 1) as f1 from r full join q using (label)"""
)
def category_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = casefiles.gold(spark, sf_dir, TAGGED)
    return evaluate.category_table(evaluate.recall_by_label(gold.withColumn("label", F.col("tag")), predicted(gold)), evaluate.precision_by_type(gold.where("tag <> 'ID'"), predicted(gold)))


@query(f"""with g as ({PEOPLE}), p as (select * from ({PREDICTED_SQL.replace("from g", f"from ({casefiles.gold_sql(TAGGED)}) g")}))
    select count(*) as n, cast(sum(case when exists (select 1 from p where p.doc_id = g.doc_id and p.start <= g.start and g."end" <= p."end") then 1 else 0 end) as bigint) as covered from g""")
def name_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names covered without the title behind them."""
    gold = casefiles.gold(spark, sf_dir, TAGGED)
    titled = gold.where("tag = 'P'").withColumns({"end": F.col("end") + 2, "value": F.concat("value", F.lit("先生"))})
    return evaluate.name_core(titled, predicted(gold))


@query()
def detect_long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine on documents of 100,000 characters and more: the files of all cases with one remainder are one document."""
    docs = casefiles.documents(spark, sf_dir).groupBy((F.col("case_id") % 8).alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return engine(spark, spread=True).detect(docs)


@query(f"with g as ({casefiles.gold_sql(['TEL', 'MAIL', 'ID'])}) select tag, count(*) as n, cast(0 as bigint) as left_over from g group by tag")
def engine_no_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole engine, from text to coded text: how many of the planted phones, e-mails and business numbers a case's texts still hold."""
    docs = casefiles.documents(spark, sf_dir)
    out = engine(spark).anonymized(docs, "case_id")
    gold = casefiles.gold(spark, sf_dir, ["TEL", "MAIL", "ID"]).join(unsent(out), "doc_id")
    return gold.groupBy("tag").agg(F.count("*").alias("n"), F.sum(F.col("text").contains(F.col("value")).cast("long")).alias("left_over"))


@query(f"select o_orderkey as doc_id, {casefiles.DATE} as value from orders")
def write_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in five notations."""
    d = F.col("o_orderdate")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("doc_id"), V.written_date(F.year(d), F.month(d), F.dayofmonth(d), F.col("o_orderkey") % 5).alias("value"))


SOME_SURNAMES = P.SURNAMES[:60]
SHARES = [10_000 // (k + 4) for k in range(len(SOME_SURNAMES))]


@query(
    f"""with w as (select unnest({SHARES}) as w, unnest({list(SOME_SURNAMES)}) as surname, generate_subscripts({SHARES}, 1) as k), c as (select *, sum(w) over (order by k) as t from w),
    u as (select c_custkey, cast(floor(((c_custkey * 7919) % 10007) / 10007.0::double * {sum(SHARES)}) as bigint) as place from customer)
    select c_custkey, surname from u join c on place < t and place >= t - w"""
)
def sample_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surnames drawn by frequency, from a number that the key gives."""
    u = ((F.col("c_custkey").cast("long") * 7919) % 10007) / F.lit(10007.0)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", V.sampled(u, list(SOME_SURNAMES), SHARES).alias("surname"))


@query("select c_custkey, length(c_name) as n, regexp_replace(regexp_replace(regexp_replace(c_name, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '0', 'g') as shape from customer")
def spoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers as other words of the same length and classes."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("w", V.pronounceable(F.col("c_name"), F.concat(F.lit("salt"), "c_name")))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("w", "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    return c.select("c_custkey", F.length("w").cast("long").alias("n"), shape.alias("shape"))


BRACKETED = f"concat('由', {casefiles.ORGANISATION}, '（下稱', substr({casefiles.ORGANISATION}, 1, 2), '公司）承作')"


@query(f"select o_orderkey as doc_id, cast(4 + length({casefiles.ORGANISATION}) as int) as start, substr({casefiles.ORGANISATION}, 1, 2) || '公司' as value, {casefiles.ORGANISATION} as \"of\" from orders")
def find_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short names in brackets behind organisations."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    docs = orders.selectExpr("o_orderkey as doc_id", f"{BRACKETED} as text")
    spans = orders.selectExpr("o_orderkey as doc_id", "1 as start", f"1 + length({casefiles.ORGANISATION}) as end", f"{casefiles.ORGANISATION} as value", "'ORG' as type")
    return consistency.aliases(docs, spans).select("doc_id", "start", "value", "of")


@query(f"with g as ({PEOPLE}) select doc_id, start, \"end\", value from g")
def reconcile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two names in a text, of which one was found cut short at one place: the longer one holds."""
    people = case_spans(spark, sf_dir, ["P"]).select("doc_id", "start", "end", "type", F.lit("full").alias("kind"), "value")
    docs = casefiles.documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit("\n"), "text").alias("text"), F.length("text").alias("n"))
    short = people.withColumns({"end": (F.col("end") - 1).cast("int"), "value": F.expr("substring(value, 1, length(value) - 1)")})
    later = people.join(docs.select("doc_id", "n"), "doc_id").withColumns({"start": (F.col("start") + F.col("n") + 1).cast("int"), "end": (F.col("end") + F.col("n") + 1).cast("int")}).drop("n")
    found = consistency.reconciled(docs, short.unionByName(later)).join(docs.select("doc_id", "n"), "doc_id")
    return found.where("start < n").select("doc_id", "start", "end", "value")
