"""Queries of the engine's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions import urls as U
from quillspan.functions.hashing import decode_key, encode_key, row_key
from quillspan.functions.stem import with_stems
from quillspan.operators.dataset import Bag, Engine, Pairs
from quillspan.operators.upsert import compare_and_set, put_cells, put_rows
from quillspan.plans import jobs as J
from quillspan.session import materialize, scratch_path, spread
from quillspan.sources.files import load_objects, once_per_prefix, read_words, write_words
from quillspan.sources.rowfile import read_rows
from quillspan.sources.store import TableStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

def _tokens(t: str) -> str:
    return f"string_split_regex(rtrim(regexp_replace(regexp_replace(lower({t}), '<[^>\\n\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]*>', ' ', 'g'), '[^a-zA-Z0-9 ]', ' ', 'g')), ' +')"


def _counts(doc: str, text: str, table: str) -> str:
    return f"t as (select {doc} as doc, unnest({_tokens(text)}) as term, len({_tokens(text)}) as words from {table} where {text} is not null)"


#: Urls that the queries here take for no pages: media, archives, and listings.
PATTERNS = [r".*[.](mp3|mp4|avi|iso)", r".*[.](zip|gz|pdf)", r".*/(tags|feed)/.*", r".*[?&]print=1.*"]
_SQL_PATTERN = "|".join(f"(?:{p})" for p in PATTERNS)
_CODES = "|".join(U.LANGUAGE_CODES)


_DIGEST = "cast('0x' || substr(sha1({u}), 2 * i + 1, 2) as int)"


def _hash_sql(u: str) -> str:
    byte = _DIGEST.format(u=u)
    x = f"(case when {byte} = 0 then 255 when {byte} > 127 then {byte} - 1 else {byte} end)"
    return f"array_to_string(list_transform(range(20), lambda i: chr(cast(97 + {x} % 26 as int)) || substr('acegikmoqs', cast({x} // 26 + 1 as int), 1)), '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(table) if name in ("documents", "pt_crawl") else table  # texts take long in the tasks


def _bag(spark: SparkSession, d: str, table: str, column: str) -> Bag:
    return Engine(spark).from_table(_t(spark, d, table), F.col(column))


def _orders(spark: SparkSession, d: str) -> Pairs:
    return Engine(spark).pairs(_t(spark, d, "orders"), F.col("o_custkey"), F.col("o_orderpriority"))


@query(f"with w as (select unnest({_tokens('text')}) as word from documents where text is not null) select word, count(*) as n from w where word <> '' group by word")
def word_count(spark, d):
    pairs = _bag(spark, d, "documents", "text").flat_map(T.words).map_to_pair(lambda v: v, lambda v: F.lit("1"))
    return pairs.aggregate_by_key(F.count(F.lit(1))).df.select(F.col("k").alias("word"), F.col("v").alias("n"))


@query("select cast(o_orderkey as varchar) as value from orders where o_totalprice > 200000 and o_orderstatus = 'O'")
def from_table_filter(spark, d):
    kept = F.when((F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "O"), F.col("o_orderkey"))
    return Engine(spark).from_table(_t(spark, d, "orders"), kept).df


@query("select p_name as value from part where lower(p_name) like '%a%' and p_name is not null")
def filter_elements(spark, d):
    return _bag(spark, d, "part", "p_name").filter(lambda v: F.lower(v).contains("a")).df


@query("select s_name as value from supplier where s_name is not null union all select c_name from customer where c_name is not null")
def union_elements(spark, d):
    return _bag(spark, d, "supplier", "s_name").union(_bag(spark, d, "customer", "c_name")).df


@query(f"select value from (select unnest({_tokens('text')}) as value from documents where text is not null) where value <> ''")
def flat_map_tokens(spark, d):
    return _bag(spark, d, "documents", "text").flat_map(T.words).df


@query("select left(x, 1) as k, x as v from (select unnest(string_split(p_type, ' ')) as x from part where p_type is not null)")
def flat_map_to_pair(spark, d):
    return _bag(spark, d, "part", "p_type").flat_map_to_pair(lambda v: F.transform(F.split(v, " "), lambda x: F.struct(F.substring(x, 1, 1), x))).df


@query("select left(c_name, 1) as k, substr(c_name, 2) as v from customer where c_name is not null")
def map_to_pair(spark, d):
    return _bag(spark, d, "customer", "c_name").map_to_pair(lambda v: F.substring(v, 1, 1), lambda v: F.substring(v, F.lit(2), F.length(v))).df


@query("select unnest([cast(o_custkey as varchar), o_orderpriority]) as value from orders")
def pair_flat_map(spark, d):
    return _orders(spark, d).flat_map(lambda k, v: F.array(k, v)).df


@query("select left(o_orderpriority, 1) as k, cast(o_custkey as varchar) as v from orders union all select 'all', o_orderpriority from orders")
def pair_flat_map_to_pair(spark, d):
    two = lambda k, v: F.array(F.struct(F.substring(v, 1, 1).alias("k"), k.alias("v")), F.struct(F.lit("all").alias("k"), v.alias("v")))
    return _orders(spark, d).flat_map_to_pair(two).df


@query("select upper(p_name) as value from part where p_name is not null")
def map_partitions(spark, d):
    return _bag(spark, d, "part", "p_name").map_partitions(lambda values: (v.upper() for v in values)).df


@query("select cast(l_orderkey as varchar) as k, sum(l_quantity) as v from lineitem group by 1")
def fold_by_key_sum(spark, d):
    pairs = Engine(spark).pairs(_t(spark, d, "lineitem"), F.col("l_orderkey"), F.col("l_quantity"))
    return pairs.aggregate_by_key(F.sum(F.col("v").cast("double"))).df


@query("select cast(o_custkey as varchar) as k, '0' || string_agg('+' || o_orderpriority, '' order by o_orderpriority) as v from orders group by 1")
def fold_by_key_ordered(spark, d):
    return _orders(spark, d).fold_by_key(F.lit("0"), lambda acc, v: F.concat(acc, F.lit("+"), v)).df


@query("select sum(l_quantity) as value from lineitem")
def fold_global(spark, d):
    return _bag(spark, d, "lineitem", "l_quantity").aggregate(F.sum(F.col("value").cast("double")))


@query("select '>' || string_agg(n_name, ';' order by n_name) || ';' as value from nation")
def fold_ordered(spark, d):
    return _bag(spark, d, "nation", "n_name").fold(F.lit(">"), lambda acc, v: F.concat(acc, v, F.lit(";")))


@query("select count(l_suppkey) as n from lineitem")
def count_elements(spark, d):
    return _bag(spark, d, "lineitem", "l_suppkey").aggregate(F.count(F.lit(1))).withColumnRenamed("value", "n")


@query("select distinct cast(l_suppkey as varchar) as value from lineitem where l_suppkey is not null")
def distinct_elements(spark, d):
    return _bag(spark, d, "lineitem", "l_suppkey").distinct().df


@query("select cast(o_custkey as varchar) as k, o_orderpriority || ',' || c_mktsegment as v from orders join customer on o_custkey = c_custkey where o_orderpriority is not null and c_mktsegment is not null")
def join_pairs(spark, d):
    right = Engine(spark).pairs(_t(spark, d, "customer"), F.col("c_custkey"), F.col("c_mktsegment"))
    return _orders(spark, d).join(right).df


@query(
    "with a as (select cast(n_regionkey as varchar) k, string_agg(n_name, ',' order by n_name) x from nation group by 1), b as (select cast(s_nationkey as varchar) k, string_agg(s_name, ',' order by s_name) x from supplier group by 1) "
    "select k, '[' || coalesce(a.x, '') || '],[' || coalesce(b.x, '') || ']' as v from a full join b using (k)"
)
def cogroup_pairs(spark, d):
    e = Engine(spark)
    return e.pairs(_t(spark, d, "nation"), F.col("n_regionkey"), F.col("n_name")).cogroup(e.pairs(_t(spark, d, "supplier"), F.col("s_nationkey"), F.col("s_name"))).df


@query("select left(p_brand, 7) as k, string_agg(p_brand, ',' order by p_brand) as v from part where p_brand is not null group by 1")
def group_by(spark, d):
    return _bag(spark, d, "part", "p_brand").group_by(lambda v: F.substring(v, 1, 7)).df


@query("select cast(c_nationkey as varchar) as value from customer intersect select cast(s_nationkey as varchar) from supplier")
def intersection(spark, d):
    return _bag(spark, d, "customer", "c_nationkey").intersection(_bag(spark, d, "supplier", "s_nationkey")).df


@query()
def sample_elements(spark, d):
    return _bag(spark, d, "lineitem", "l_orderkey").sample(0.1, seed=7).df


@query("select cast(o_orderkey as varchar) as value from orders order by 1 limit 25")
def take_ordered(spark, d):
    return _bag(spark, d, "orders", "o_orderkey").df.orderBy("value").limit(25)


def _store(spark: SparkSession, d: str, **tables: tuple[str, str]) -> TableStore:
    """A store with whole tables, keyed by a column each."""
    store = TableStore(spark, scratch_path(spark, "store"))
    for name, (table, key) in tables.items():
        store.write(name, _t(spark, d, table).withColumnRenamed(key, "key"))
    return store


@query("select o_orderkey, o_orderstatus from orders where o_orderkey >= 1000 and o_orderkey < 4000")
def range_scan(spark, d):
    return _store(spark, d, orders=("orders", "o_orderkey")).scan("orders", 1000, 4000).select(F.col("key").alias("o_orderkey"), "o_orderstatus")


@query("select c_custkey, c_name from customer where c_custkey >= 40 order by c_custkey limit 11")
def keyset_page(spark, d):
    rows, following = _store(spark, d, customer=("customer", "c_custkey")).page("customer", 40, 10)
    last = _t(spark, d, "customer").where(F.col("c_custkey") == F.lit(following)).select("c_custkey", "c_name")
    page = spark.createDataFrame([(r["key"], r["c_name"]) for r in rows], "c_custkey long, c_name string")  # a page of ten
    return page.unionByName(last)


@query("select c_custkey, c_name from customer order by c_custkey limit 10 offset 20")
def offset_page(spark, d):
    return _t(spark, d, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(20).limit(10)


@query("select c_custkey, c_name from customer where c_custkey = 77")
def point_lookup(spark, d):
    store = _store(spark, d, customer=("customer", "c_custkey"))
    row, name = store.get_row("customer", 77), store.get("customer", 77, "c_name")
    return spark.createDataFrame([(row["key"], name)] if row else [], "c_custkey long, c_name string")


@query("select 'nation' as name, count(*) as n from nation union all select 'places', count(*) from region where r_regionkey not in (1, 2) union all select 'changed', 2 union all select 'gone', 0")
def stored_tables(spark, d):
    """Tables after puts, a rename and a deletion, with their rows; the changed rows that are found again."""
    store = _store(spark, d, nation=("nation", "n_nationkey"), region=("region", "r_regionkey"), gone=("region", "r_regionkey"))
    store.write("region", store.read("region").where("key not in (1, 2)"), replace=True)
    puts = materialize(store.read("nation").where("key in (3, 4)").withColumn("n_name", F.lit("changed")), "puts")
    store.put_rows("nation", puts)
    store.rename("region", "places")
    store.delete("gone")
    changed = store.having("nation", puts.select("key")).count() if store.get("nation", 3, "n_name") == "changed" else -1
    rows = [*store.overview(), ("changed", changed), ("gone", store.count("gone"))]
    return spark.createDataFrame(rows, "name string, n long")


@query("select value from (values ('a'), ('b'), ('b'), (''), ('z y')) t(value)")
def parallelize(spark, d):
    return Engine(spark).parallelize(["a", "b", "b", "", "z y"]).df


@query("select '(' || left(n_name, 1) || ',' || substr(n_name, 2) || ')' as value from nation")
def shown_pairs(spark, d):
    return _bag(spark, d, "nation", "n_name").map_to_pair(lambda v: F.substring(v, 1, 1), lambda v: F.substring(v, F.lit(2), F.length(v))).shown()


@query("select lower(p_name) as value from part where p_name is not null and p_size is not null and length(p_name) % 2 = 0")
def python_functions(spark, d):
    """Opaque Python functions as filter and flat map."""
    names = Engine(spark).from_table(_t(spark, d, "part").where("p_size is not null"), F.col("p_name"))
    return names.filter(lambda v: len(v) % 2 == 0, python=True).flat_map(lambda v: [v.lower()], python=True).df


@query("select left(c_mktsegment, 1) as k, cast(sum(length(c_name)) as varchar) as v from customer where c_mktsegment is not null and c_name is not null group by 1")
def python_fold_by_key(spark, d):
    """Opaque Python functions as map to pair and fold by key."""
    pairs = Engine(spark).pairs(_t(spark, d, "customer").where("c_mktsegment is not null and c_name is not null"), F.col("c_mktsegment"), F.col("c_name"))
    return pairs.flat_map_to_pair(lambda k, v: [(k[0], str(len(v)))], python=True).fold_by_key("0", lambda acc, v: str(int(acc) + int(v)), python=True).df


@query("select distinct trim(p_brand) as term from part where trim(p_brand) <> ''")
def word_list(spark, d):
    """A word list written as text and read again."""
    path = scratch_path(spark, "words")
    write_words(_t(spark, d, "part"), path, "p_brand")
    return read_words(spark, path)


@query("select n_name as page, length(n_name) as length from nation")
def loaded_objects(spark, d):
    """Text files loaded as objects."""
    path = scratch_path(spark, "objects")
    _t(spark, d, "nation").select("n_nationkey", "n_name").repartition(25, "n_nationkey").select(F.col("n_name").alias("value"), F.col("n_nationkey").alias("n")).write.partitionBy("n").option("lineSep", "\\u0001").text(path)
    return load_objects(spark, path).select(F.regexp_replace("page", "\\\\u0001$|\u0001$", "").alias("page")).select("page", F.length("page").alias("length"))


@query()
def row_file_records(spark, d):
    """Complete records of all row files: key, crawl id and page bytes."""
    rows = read_rows(_t(spark, d, "crawl_files").select("body"))
    return rows.select("key", F.element_at("cols", "crawlId").cast("string").cast("long").alias("crawl_id"), F.length(F.element_at("cols", "page")).alias("page_bytes"))


@query("select host, len(rules) as n, list_transform(rules, lambda r: r.rule_type || '::' || r.prefix) as rules from hosts where rules is not null and len(list_filter(rules, lambda r: r.rule_type is null or r.prefix is null)) = 0")
def unpacked_rules(spark, d):
    """Robots rules packed into one field and unpacked again."""
    known = _t(spark, d, "hosts").where("rules is not null and not exists(rules, r -> r.rule_type is null or r.prefix is null)")
    back = known.select("host", U.unpack_rules(U.pack_rules(F.col("rules"))).alias("rules"))
    return back.select("host", F.size("rules").alias("n"), F.transform("rules", lambda r: F.concat(r["rule_type"], F.lit("::"), r["prefix"])).alias("rules"))


@query("select host, list_transform(coalesce(rules, []), lambda r: r.rule_type || ' ' || r.prefix) as rules from hosts where host is not null and len(list_filter(coalesce(rules, []), lambda r: r.rule_type is null or r.prefix is null)) = 0")
def parsed_robots(spark, d):
    """The rules of each host written as a robots file, and parsed."""
    known = _t(spark, d, "hosts").where("host is not null and not exists(coalesce(rules, array()), r -> r.rule_type is null or r.prefix is null)")
    lines = F.array_join(F.transform("rules", lambda r: F.concat(r["rule_type"], F.lit(": "), r["prefix"])), "\n")
    text = F.concat(F.lit("User-agent: other\nDisallow: /\n\nUser-agent: us\nUser-agent: them\n"), F.coalesce(lines, F.lit("")))
    return known.select("host", U.parse_robots(text, F.lit("us")).alias("p")).select("host", F.transform("p.rules", lambda r: F.concat(r["rule_type"], F.lit(" "), r["prefix"])).alias("rules"))


@query("select crawl_id, unnest(regexp_extract_all(page, '<a href=\"([^\">]+)\">', 1)) as link from pt_crawl where page is not null")
def raw_links(spark, d):
    """Links as a crawl finds them, of anchors that have but a quoted href."""
    pages = _t(spark, d, "pt_crawl").where("page is not null")
    plain = F.array_join(F.regexp_extract_all("page", F.lit('<a href="[^">]+">'), F.lit(0)), "")
    return pages.select("crawl_id", F.explode_outer(U.raw_links(plain)).alias("link")).where("link is not null")


@query("select host, replace(replace(host, '_', '_5f'), '.', '_2e') as name, host as back from hosts where host is not null")
def decoded_keys(spark, d):
    named = _t(spark, d, "hosts").where("host is not null").select("host", encode_key(F.col("host")).alias("name"))
    return named.select("host", "name", decode_key(F.col("name")).alias("back"))


@query(f"select url, {_hash_sql('url')} as key from pt_crawl where url is not null and page is not null")
def resharded(spark, d):
    return J.reshard(_t(spark, d, "pt_crawl").where("url is not null and page is not null").select("url"), 16).select("url", "key")


@query("select distinct url from pt_crawl where url is not null and url not in (select url from documents where url is not null)")
def anti_join_seen(spark, d):
    return _t(spark, d, "pt_crawl").select("url").where("url is not null").distinct().join(_t(spark, d, "documents").select("url"), "url", "left_anti")


@query(f"with w as (select doc_id, unnest({_tokens('text')}) as term from documents where text is not null) select doc_id, term from w where term in (select term from pt_idf where term is not null and term <> '')")
def semi_join_lexicon(spark, d):
    words = _t(spark, d, "documents").select("doc_id", F.explode_outer(T.words(F.col("text"))).alias("term")).where("term is not null")
    return J.join_small(words, _t(spark, d, "pt_idf").where("term is not null").select("term").distinct(), ["term"], "left_semi", spread=["doc_id"])


_LIST = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(f"with w as (select unnest({_tokens('text')}) as term from documents where text is not null) select distinct term from w where term <> '' and term not in ({_LIST})")
def stop_words_removed(spark, d):
    words = _t(spark, d, "documents").select(F.explode_outer(T.words(F.col("text"))).alias("term")).where("term is not null")
    return words.where(~F.col("term").isin(T.STOP_WORDS)).distinct()


@query(f"select url, {_hash_sql('url')} as key from (select distinct url from pt_crawl where url is not null)")
def url_hash(spark, d):
    return _t(spark, d, "pt_crawl").select("url").where("url is not null").distinct().select("url", row_key(F.col("url")).alias("key"))


@query("select count(*) as n from (select distinct url, page_key from pt_crawl where url is not null)")
def url_hash_is_page_key(spark, d):
    rows = _t(spark, d, "pt_crawl").where("url is not null").select("url", "page_key").distinct()
    return rows.where(row_key(F.col("url")) == F.col("page_key")).agg(F.count(F.lit(1)).alias("n"))


_ANCHOR = """(?i)<a[^>]*href=["'']([^"''#>]+)["''][^>]*>"""


@query(f"select crawl_id, unnest(regexp_extract_all(page, '{_ANCHOR}', 1)) as link from pt_crawl where page is not null")
def extract_links(spark, d):
    return _t(spark, d, "pt_crawl").select("crawl_id", F.explode_outer(F.regexp_extract_all("page", F.lit(U._ANCHOR), F.lit(1))).alias("link")).where("link is not null")


_LATEST = "latest as (select page_key, url, host, page from (select *, row_number() over (partition by page_key order by crawl_id desc nulls last, url) n from pt_crawl where page is not null and page <> '' and page_key is not null) where n = 1)"
_LINKS = f"links as (select page_key as src, url, trim(unnest(regexp_extract_all(page, '{_ANCHOR}', 1))) as link from latest)"
_TARGETS = "targets as (select src, case when link similar to '(http|https)://.*' then link else regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1) || link end as dst from links where link similar to '((http|https)://|/).*')"


@query(f"with {_LATEST}, {_LINKS}, {_TARGETS} select src, dst, count(*) as n from targets where not regexp_matches(regexp_extract(dst, '^[a-z]+://[^/]*([^?#]*)', 1), '[.](jpg|jpeg|png|gif|svg|css|js)$') group by src, dst")
def resolved_links(spark, d):
    pages = J.latest_pages(_t(spark, d, "pt_crawl"), links=U.links(F.col("page")))
    each = pages.select(F.col("page_key").alias("src"), "url", F.explode_outer("links").alias("link"))
    return each.select("src", U.absolute(F.col("url"), F.col("link")).alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query("select crawl_id, trim(substr(trim(regexp_replace(regexp_replace(page, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 100), '') as preview from pt_crawl where page is not null")
def snippet(spark, d):
    return _t(spark, d, "pt_crawl").where("page is not null").select("crawl_id", T.snippet(F.col("page")).alias("preview"))


@query("select url, len(string_split(regexp_replace(url, '/+$', ''), '/')) as depth from pt_crawl where url is not null")
def url_depth(spark, d):
    return _t(spark, d, "pt_crawl").where("url is not null").select("url", U.depth(F.col("url")).alias("depth"))


@query(f"select url, url is null or url = '' or regexp_matches(regexp_replace(lower(url), '/+$', ''), '^(?:{_SQL_PATTERN})$') as hit from pt_crawl")
def url_blacklist(spark, d):
    return _t(spark, d, "pt_crawl").select("url", U.matches_any(F.col("url"), PATTERNS).alias("hit"))


@query(f"select url, regexp_matches(lower(url), '/({_CODES})(/|$)|(lang|language|locale)=({_CODES})') as hit from documents where url is not null")
def url_language(spark, d):
    return _t(spark, d, "documents").where("url is not null").select("url", U.language_marked(F.col("url")).alias("hit"))


@query("select url, regexp_extract(url, '^([a-z]+)://', 1) as protocol, regexp_extract(url, '^[a-z]+://([^/:]*)', 1) as host, regexp_extract(url, '^[a-z]+://[^/:]*:([^/]*)', 1) as port, regexp_extract(url, '^[a-z]+://[^/]*(/.*)$', 1) as path from pt_crawl where url is not null")
def url_parts(spark, d):
    return _t(spark, d, "pt_crawl").where("url is not null").select("url", U.parts(F.col("url")).alias("p")).select("url", "p.*")


@query("select crawl_id, response_code in (301, 302, 303, 307, 308) as redirect from pt_crawl")
def redirects(spark, d):
    return _t(spark, d, "pt_crawl").select("crawl_id", U.is_redirect(F.col("response_code")).alias("redirect"))


@query("select term, url_encode(term) as encoded from pt_idf where term is not null")
def form_encoded_terms(spark, d):
    return _t(spark, d, "pt_idf").where("term is not null").select("term", U.form_encode(F.col("term")).alias("encoded"))


@query("select host, replace(replace(host, '_', '_5f'), '.', '_2e') as name from hosts")
def encoded_keys(spark, d):
    return _t(spark, d, "hosts").select("host", encode_key(F.col("host")).alias("name"))


_FORM = "replace(replace(replace(url_encode({}), '%20', '+'), '%2A', '*'), '~', '%7E')"


@query(
    f"select url, case when contains(url, '?') then string_split(url, '?')[1] || '?' || replace(replace({_FORM.format("regexp_extract(url, '[?](.*)$', 1)")}, '%3D', '='), '%26', '&') "
    f"else replace(replace({_FORM.format('url')}, '%3A', ':'), '%2F', '/') end as clean from pt_crawl where url is not null"
)
def sanitized_urls(spark, d):
    return _t(spark, d, "pt_crawl").where("url is not null").select("url", U.sanitize(F.col("url")).alias("clean"))


@query("select host, coalesce(array_to_string(list_transform(rules, lambda r: r.rule_type || '::' || r.prefix || ',,'), ''), '') as packed from hosts")
def packed_rules(spark, d):
    return _t(spark, d, "hosts").select("host", F.coalesce(U.pack_rules(F.col("rules")), F.lit("")).alias("packed"))


@query(
    "with h as (select host, first(rules) as rules from hosts group by host), u as (select distinct c.url, regexp_extract(c.url, '^[^/]*//[^/]*([^?]*)', 1) as path, h.rules from pt_crawl c left join h using (host) where c.url is not null) "
    "select url, coalesce((list_filter(rules, lambda r: starts_with(path, coalesce(r.prefix, ''))))[1].rule_type = 'allow', true) as ok from u"
)
def robots_allowed(spark, d):
    rules = _t(spark, d, "hosts").groupBy("host").agg(F.first("rules").alias("rules"))
    urls = _t(spark, d, "pt_crawl").where("url is not null").select("url", "host").distinct()
    joined = J.join_small(urls, rules, ["host"], "left", spread=["url"])
    return joined.select("url", U.allowed(F.regexp_extract("url", "^[^/]*//[^/]*([^?]*)", 1), F.col("rules")).alias("ok")).distinct()


_DOC_COUNTS = _counts(doc="doc_id", text="text", table="documents")
_PAGE_COUNTS = _counts(doc="page_key", text="page", table="latest")


@query(f"with {_DOC_COUNTS} select doc, term, round(count(*) / any_value(words), 9) as tf from t where term <> '' group by doc, term")
def tf_documents(spark, d):
    return J.term_frequency(_t(spark, d, "documents"), "doc_id", "text").select("doc", "term", F.round("tf", 9).alias("tf"))


@query(f"with {_LATEST}, {_PAGE_COUNTS} select doc, term, round(count(*) / any_value(words), 9) as tf from t where term <> '' group by doc, term")
def tf_pages(spark, d):
    return J.page_term_frequency(_t(spark, d, "pt_crawl")).select("doc", "term", F.round("tf", 9).alias("tf"))


def _doc_terms(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.explode_outer(F.array_distinct(T.words(F.col("text")))).alias("term")).where("term is not null")


@query(f"with {_DOC_COUNTS} select term, round(ln((select count(*) from documents) / count(distinct doc)), 9) as idf from t where term <> '' group by term")
def idf_log(spark, d):
    n = _t(spark, d, "documents").count()
    return J.idf_log(_doc_terms(spark, d), n).select("term", F.round("idf", 9).alias("idf"))


@query(f"with {_DOC_COUNTS} select term, round(ln((select count(*) from documents) / (1 + count(distinct doc))), 9) as idf from t where term <> '' group by term")
def idf_smoothed(spark, d):
    n = _t(spark, d, "documents").count()
    return J.idf_smoothed(_doc_terms(spark, d), n).select("term", F.round("idf", 9).alias("idf"))


@query(f"with {_DOC_COUNTS} select term, count(distinct doc) as df from t where term <> '' group by term")
def document_frequency(spark, d):
    return J.document_frequency(_doc_terms(spark, d))


@query(f"with {_LATEST}, p as (select distinct unnest({_tokens('page')}) as term, url from latest) select term, 0 as shard, string_agg(url, ',' order by url) as urls from p where term <> '' and term in (select term from pt_idf) group by term")
def inverted_index(spark, d):
    return J.packed_index(J.page_postings(_t(spark, d, "pt_crawl"), _t(spark, d, "pt_idf").where("term is not null")))


@query()
def inverted_index_stemmed(spark, d):
    """The index of stems, of those that are in the lexicon."""
    lex = J.lexicon(_t(spark, d, "pt_idf").where("term is not null"), "term")
    return J.packed_index(J.page_postings(_t(spark, d, "pt_crawl"), lex, stems=True))


@query(f"with {_LATEST}, p as (select distinct unnest({_tokens('page')}) as term, url from latest), q as (select term, url from p where term <> '' and term in (select term from pt_idf)) select term, round(ln((select count(distinct url) from q) / (1 + count(*))), 9) as idf from q group by term")
def idf_of_index(spark, d):
    """Smoothed idf by the documents of the index."""
    pairs = materialize(J.page_postings(_t(spark, d, "pt_crawl"), _t(spark, d, "pt_idf").where("term is not null")), "postings")
    return J.index_idf(pairs).select("term", F.round("idf", 9).alias("idf"))


@query(f"with {_LATEST}, p as (select distinct unnest({_tokens('page')}) as term, url from latest), q as (select term, url from p where term <> '' and term in (select term from pt_idf) union select host, 'http://seed.test:80/' from hosts where host is not null) select term, 0 as shard, string_agg(url, ',' order by url) as urls from q group by term")
def extended_index(spark, d):
    """Pages indexed into an index that holds other lists already."""
    held = J.packed_index(_t(spark, d, "hosts").where("host is not null").select(F.col("host").alias("term"), F.lit("http://seed.test:80/").alias("url")).distinct())
    return J.extend_index(held, J.page_postings(_t(spark, d, "pt_crawl"), _t(spark, d, "pt_idf").where("term is not null")))


@query(
    "with a as (select o_orderpriority as term, string_agg(cast(o_orderkey as varchar), ',' order by cast(o_orderkey as varchar)) as urls from orders group by 1), b as (select c_mktsegment as term, string_agg(cast(c_custkey as varchar), ',' order by cast(c_custkey as varchar)) as urls from customer group by 1 union all select distinct o_orderpriority, 'x' from orders) "
    "select term, case when a.urls is null then b.urls when b.urls is null then a.urls else a.urls || ',' || b.urls end as urls from a full join b using (term)"
)
def index_merge(spark, d):
    packed = lambda df, t, u: df.groupBy(F.col(t).alias("term")).agg(F.array_join(F.array_sort(F.collect_list(F.col(u).cast("string"))), ",").alias("urls"))
    orders = _t(spark, d, "orders")
    source = packed(_t(spark, d, "customer"), "c_mktsegment", "c_custkey").unionByName(orders.select(F.col("o_orderpriority").alias("term")).distinct().withColumn("urls", F.lit("x")))
    return J.merge_index(packed(orders, "o_orderpriority", "o_orderkey"), source)


@query()
def lexicon_stems(spark, d):
    words = _t(spark, d, "documents").select(F.explode_outer(T.words(F.col("text"))).alias("value"))
    return J.lexicon(words)


@query()
def tf_stemmed(spark, d):
    return J.term_frequency(_t(spark, d, "documents"), "doc_id", "text", stems=True)


@query()
def idf_stemmed(spark, d):
    return J.idf_log(with_stems(_doc_terms(spark, d), "term").select("doc", F.col("stem").alias("term")), _t(spark, d, "documents").count())


_EDGES = f"{_LATEST}, {_LINKS}, {_TARGETS}, edges as (select src, {_hash_sql('dst')} as dst from targets where not regexp_matches(regexp_extract(dst, '^[a-z]+://[^/]*([^?#]*)', 1), '[.](jpg|jpeg|png|gif|svg|css|js)$')), deg as (select src, count(*) as n from edges group by src), r0 as (select page_key as id, 1.0::double as r from latest)"
_STEP = "r{b} as (select l.page_key as id, 0.15 + 0.85 * coalesce(f.x, 0) as r from latest l left join (select e.dst, sum(p.r / d.n) as x from edges e join r{a} p on p.id = e.src join deg d on d.src = e.src group by e.dst) f on f.dst = l.page_key)"


@query(f"with {_EDGES}, " + ", ".join(_STEP.format(a=i, b=i + 1) for i in range(5)) + " select id, round(r, 6) as rank from r5")
def pagerank(spark, d):
    pages = J.latest_links(_t(spark, d, "pt_crawl"))
    ranks = J.pagerank(J.link_edges(pages), pages.select(F.col("page_key").alias("id")), rounds=5)
    return ranks.select("id", F.round("rank", 6).alias("rank"))


_TRADE = "edges as (select cast(c_nationkey as varchar) src, cast(s_nationkey as varchar) dst from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey), deg as (select src, count(*) n from edges group by src), latest as (select cast(n_nationkey as varchar) as page_key from nation), r0 as (select page_key as id, 1.0::double as r from latest)"


def _trade(spark, d):
    rows = _t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("c_nationkey").cast("string").alias("src"), F.col("s_nationkey").cast("string").alias("dst"))


@query(f"with {_TRADE}, " + ", ".join(_STEP.format(a=i, b=i + 1) for i in range(5)) + " select id, round(r, 6) as rank from r5")
def pagerank_trade(spark, d):
    ranks = J.pagerank(_trade(spark, d), _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id")), rounds=5)
    return ranks.select("id", F.round("rank", 6).alias("rank"))


_ROUNDS = 16
_CONVERGED = ", ".join(f"s{i} as (select {i} as n, a.id, a.r as rank, b.r as prev, max(abs(a.r - b.r)) over () as moved from r{i} a join r{i - 1} b using (id))" for i in range(1, _ROUNDS))


@query(
    f"with {_TRADE}, " + ", ".join(_STEP.format(a=i, b=i + 1).replace(" as (", " as materialized (", 1) for i in range(_ROUNDS - 1)) + f", {_CONVERGED}, every as (" + " union all ".join(f"select * from s{i}" for i in range(1, _ROUNDS)) + ") "
    "select id, round(rank, 6) as rank, round(prev, 6) as prev from every where n = (select min(n) from every where moved <= 0.001)"
)
def pagerank_converged(spark, d):
    ranks = J.pagerank(_trade(spark, d), _t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("id")), epsilon=0.001)
    return ranks.select("id", F.round("rank", 6).alias("rank"), F.round("prev", 6).alias("prev"))


@query("select round(avg(case when abs(rank - prev) <= 0.005 then 1.0 else 0.0 end), 9) as converged from pt_pageranks where rank is not null and prev is not null")
def convergence_ratio(spark, d):
    rows = _t(spark, d, "pt_pageranks").where("rank is not null and prev is not null")
    return rows.agg(F.round(F.avg((F.abs(F.col("rank") - F.col("prev")) <= 0.005).cast("double")), 9).alias("converged"))


_ASKED = "Work, page; archive-ledger (work)?"


def _statistics(spark, d):
    tf = _t(spark, d, "pt_tf").where("doc is not null and term is not null").groupBy("doc", "term").agg(F.max("value").alias("tf"))
    idf = _t(spark, d, "pt_idf").where("term is not null").groupBy("term").agg(F.max("idf").alias("idf"))
    ranks = _t(spark, d, "pt_pageranks").groupBy(F.col("page_key").alias("id")).agg(F.max(F.struct("computed_at", "rank")).alias("r")).select("id", F.col("r.rank").alias("rank"))
    return tf, idf, ranks


def _found(spark, d):
    return J.search(J.query_terms(spark, _ASKED), *_statistics(spark, d), n=20)


@query(
    "with tf as (select doc, term, max(value) as tf from pt_tf where doc is not null and term in ('work', 'page', 'archive', 'ledger') group by doc, term), i as (select term, max(idf) as idf from pt_idf group by term), r as (select page_key, arg_max_null(rank, computed_at) as rank from pt_pageranks group by page_key), "
    "s as (select doc, sum(0.95 * coalesce(tf, 0) * coalesce(idf, 0)) as x, count(*) as m from tf left join i using (term) group by doc) select doc, round(x + 0.05 * m * coalesce(rank, 0), 9) as score from s left join r on doc = page_key order by x + 0.05 * m * coalesce(rank, 0) desc, doc limit 20"
)
def search_topk(spark, d):
    return _found(spark, d).select("doc", F.round("score", 9).alias("score"))


_HITS = (
    "tf as (select doc, term, max(value) as tf from pt_tf where doc is not null and term in ('work', 'page', 'archive', 'ledger') group by doc, term), i as (select term, max(idf) as idf from pt_idf group by term), r as (select page_key, arg_max_null(rank, computed_at) as rank from pt_pageranks group by page_key)"
)


@query(
    f"with {_LATEST}, p as (select distinct unnest({_tokens('page')}) as term, url from latest), h as (select term, url, {_hash_sql('url')} as doc from p where term in ('work', 'page', 'archive', 'ledger')), {_HITS}, "
    "s as (select url, doc, sum(coalesce(tf, 0) * coalesce(idf, 0)) as x, count(*) as m from h left join tf using (doc, term) left join i using (term) group by url, doc) "
    "select url, round(0.95 * x + 0.05 * m * coalesce(rank, 0), 9) as score from s left join r on doc = page_key order by 0.95 * x + 0.05 * m * coalesce(rank, 0) desc, url limit 20"
)
def search_from_index(spark, d):
    """Ranked search that starts from the postings: what has no frequency, idf or rank counts 0."""
    words = J.query_terms(spark, _ASKED)
    best = J.search_index(words, J.page_postings(_t(spark, d, "pt_crawl"), words), *_statistics(spark, d), n=20)
    return best.select("url", F.round("score", 9).alias("score"))


@query()
def search_stemmed(spark, d):
    """Ranked search over stems: index, frequencies, idf and query are stemmed alike."""
    crawl = _t(spark, d, "pt_crawl")
    words = J.query_terms(spark, _ASKED, stems=True)
    pairs = materialize(J.page_postings(crawl, stems=True), "postings")
    tf = J.page_term_frequency(crawl, stems=True)
    return J.search_index(words, pairs, tf, J.index_idf(pairs), _statistics(spark, d)[2], n=20).select("url", F.round("score", 9).alias("score"))


@query(
    f"with {_LATEST}, {_HITS}, s as (select doc, sum(0.95 * coalesce(tf, 0) * coalesce(idf, 0)) as x, count(*) as m from tf left join i using (term) group by doc), b as (select doc, x + 0.05 * m * coalesce(rank, 0) as score from s left join r on doc = page_key order by score desc, doc limit 20), "
    "v as (select doc, score, coalesce(url, '') as url, coalesce(trim(substr(trim(regexp_replace(regexp_replace(page, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 100), ''), '') as preview from b left join latest on doc = page_key) "
    "select cast(to_json(list({{'url': url, 'preview': preview}} order by score desc, doc)) as varchar) as json from v".replace("{{", "{").replace("}}", "}")
)
def search_json(spark, d):
    return J.as_json(J.with_snippets(_found(spark, d), _t(spark, d, "pt_crawl")))


@query("select url, host from (select url, host, row_number() over (partition by host order by url) as n from (select distinct url, host from pt_crawl where url is not null)) where n <= 3")
def host_cap(spark, d):
    urls = _t(spark, d, "pt_crawl").where("url is not null").select("url", "host").distinct()
    return J.first_per_group(urls, "host", [F.col("url")], 3, "url")


@query()
def frontier(spark, d):
    return J.crawl_round(_t(spark, d, "pt_crawl"), _t(spark, d, "documents").select("url"), _t(spark, d, "hosts"), codes=U.LANGUAGE_CODES, patterns=PATTERNS)


@query()
def crawled(spark, d):
    """A whole crawl of the stored pages from the urls of the hosts' first pages on, until the queue is empty."""
    pages = materialize(J.latest_pages(_t(spark, d, "pt_crawl"), page=F.col("page")).withColumn("url", U.crawl_form(F.col("url"), F.col("url"))), "web")
    seeds = pages.groupBy("host").agg(F.min("url").alias("url")).select("url")
    fetch = lambda queue: pages.join(queue.select("url"), "url", "left_semi")
    return J.crawl_all(fetch, seeds, _t(spark, d, "hosts"), cap=1 << 40).select("page_key", "url")


@query("with new as (select o_custkey as key, max(o_orderpriority) as value from orders group by o_custkey) select key, value from new union all select c_custkey, c_name from customer where c_custkey not in (select key from new)")
def upsert_rows(spark, d):
    old = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    new = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderpriority").alias("value"))
    return put_rows(old, new, "key")


@query("select o_custkey as key, o_orderpriority as column, max_by(o_orderstatus, o_orderkey) as value from orders group by 1, 2")
def upsert_cells(spark, d):
    puts = _t(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("column"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("seq"))
    return put_cells(puts.limit(0).select("key", "column", "value"), puts)


@query("with ch as (select o_custkey as key from orders group by o_custkey) select c_custkey as key, case when ch.key is not null and c_mktsegment = 'BUILDING' then 'DONE' else c_mktsegment end as value, case when ch.key is not null then c_mktsegment = 'BUILDING' end as applied from customer left join ch on ch.key = c_custkey")
def compare_and_set_cells(spark, d):
    old = _t(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    changes = _t(spark, d, "orders").select(F.col("o_custkey").alias("key")).distinct().select("key", F.lit("BUILDING").alias("expected"), F.lit("DONE").alias("value"))
    return compare_and_set(old, changes, "key", "value")


@query("select n_name as key, n_name as original, lower(n_name) as lowered from nation")
def row_projection(spark, d):
    return _t(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_name").alias("original"), F.lower("n_name").alias("lowered"))


@query("select distinct url, left(url, 24) as start from (select url, row_number() over (partition by left(url, 24) order by url) as n from pt_crawl where url is not null) where n = 1")
def once_per_prefix_urls(spark, d):
    urls = once_per_prefix(_t(spark, d, "pt_crawl").select("url").where("url is not null"), "url", 24)
    return urls.select("url", F.substring("url", 1, 24).alias("start"))


@query("with i as (select distinct term, urls from pt_idf left join (select distinct term as term, 1 as urls from pt_tf) using (term) where term is not null) select term, case when urls is null then '' else 'known' end as urls from i")
def seeded_index(spark, d):
    known = _t(spark, d, "pt_tf").where("term is not null").select("term").distinct().withColumn("urls", F.lit("known"))
    lex = _t(spark, d, "pt_idf").where("term is not null").select("term")
    return J.seed_index(lex, known).join(lex.distinct(), "term", "left_semi")


@query("select host, count(*) as urls, max(fetched_at) as last_fetch from pt_crawl group by host")
def host_activity(spark, d):
    return _t(spark, d, "pt_crawl").groupBy("host").agg(F.count(F.lit(1)).alias("urls"), F.max("fetched_at").alias("last_fetch"))
