"""The rest of the inventory that has results of its own: queries and SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions import text as X
from quarryline.functions import vectors as V
from quarryline.operators import analyzers as N
from quarryline.operators import changes as C
from quarryline.operators import chunkers as K
from quarryline.operators import embedding as E
from quarryline.operators import metrics as M
from quarryline.operators import relations as L
from quarryline.operators import retrieval as R
from quarryline.operators import summary as P
from quarryline.plans import pipelines
from quarryline.plans.reference_rank import NAMED, VECTOR, _V, _some
from quarryline.plans.reference_scan import _STATES, _states
from quarryline.plans.reference_stats import _TECH
from quarryline.plans.registry import Registry, Tables
from quarryline.sources.store import Store
from quarryline.sources.tables import shared_folder
from quarryline.streaming import watch as W

query = Registry()


@query("S03_rich_scan", "select file_id, lower(regexp_extract(relative_path, '(\\.[^./]*)$', 1)) as extension, hash, size from files where size <= 10485760 and size > 0")
def _(t: Tables) -> DataFrame:
    return t.files.where("size <= 10485760 and size > 0").select("file_id", X.ending(F.col("relative_path")).alias("extension"), "hash", "size")


@query("S16_vector_source", "select c.repo_id, v.chunk_id, count(*) as n from embedded_chunks v join (select distinct repo_id, chunk_id from chunks) c using (chunk_id) where v.embedding is not null group by all")
def _(t: Tables) -> DataFrame:
    owners = t.chunks.select("repo_id", "chunk_id").distinct()
    return t.embedded_chunks.where("embedding is not null").join(owners, "chunk_id").groupBy("repo_id", "chunk_id").agg(F.count("*").alias("n"))


@query("S18_enriched_round_trip")
def _(t: Tables) -> DataFrame:
    store = Store(t.spark, shared_folder(t.spark, "store"))
    texts = K.whole_texts(t.chunks, "file_id", "file_hash", "relative_path")
    rows = texts.select(F.col("relative_path").alias("rel_path"), F.col("file_hash").alias("hash"), X.language(F.col("relative_path")).alias("language"), F.col("text").alias("content"))
    store.replace("chunks", pipelines.chunked(rows, "all", 4000))
    return store.read("chunks").select("rel_path", "ordinal", "kind", F.size("functions").alias("functions"), F.size("imports").alias("imports"))


@query("S19_fallback_source", "select c.chunk_id, coalesce(nullif(e.code_language, ''), 'unknown') as language, coalesce(c.content, 'gone') as content from (select distinct chunk_id, content from chunks) c left join (select entry_id, max(code_language) as code_language from index_entries group by 1) e on e.entry_id = c.chunk_id")
def _(t: Tables) -> DataFrame:
    e = t.index_entries.groupBy("entry_id").agg(F.max("code_language").alias("code_language"))
    out = t.chunks.select("chunk_id", "content").distinct().join(e, F.col("entry_id") == F.col("chunk_id"), "left")
    return out.select("chunk_id", F.coalesce(F.nullif("code_language", F.lit("")), F.lit("unknown")).alias("language"), F.coalesce("content", F.lit("gone")).alias("content"))


@query("S20_catalog", "select entry_id, max(rel_path) as rel_path, 'renamed' as alias from index_entries where entry_id is not null group by 1")
def _(t: Tables) -> DataFrame:
    store = Store(t.spark, shared_folder(t.spark, "store"))
    rows = t.index_entries.where("entry_id is not null").groupBy("entry_id").agg(F.max("rel_path").alias("rel_path"), F.max("alias").alias("alias"))
    store.replace("catalog", rows)
    store.upsert("catalog", rows.withColumn("alias", F.lit("renamed")), "entry_id")
    return store.read("catalog")


@query("S23_flat_index", f"select vec_id::varchar as chunk_id, round(list_dot_product(embedding::double[], {_V}), 6) as dot from embeddings order by list_dot_product(embedding::double[], {_V}) desc, vec_id::varchar limit 20")
def _(t: Tables) -> DataFrame:
    # an index is created, saved, added to and loaded again before it is searched
    store, empty = Store(t.spark, shared_folder(t.spark, "store")), F.lit(None).cast("string")
    rows = t.embeddings.select(F.col("label").cast("string").alias("repo_id"), F.col("vec_id").cast("string").alias("chunk_id"), "embedding", empty.alias("provider"), empty.alias("text_sha"))
    store.replace("vectors", rows.where(F.col("chunk_id").endswith("0")))
    store.append("vectors", rows.where(~F.col("chunk_id").endswith("0")))
    return R.dot_search(store.read("vectors"), "embedding", VECTOR, 20, -1.0, "chunk_id").select("chunk_id", F.round("dot", 6).alias("dot"))


@query("S25_sliced_store", "select floor((row_number() over (order by vec_id) - 1) / 1000)::int as slice, vec_id from (select distinct vec_id from embedded_chunks where vec_id is not null)")
def _(t: Tables) -> DataFrame:
    ids = C.dense_numbers(t.embedded_chunks.where("vec_id is not null").select("vec_id").distinct(), "vec_id")
    return ids.select(F.floor(F.col("number") / 1000).cast("int").alias("slice"), "vec_id")


@query("S29_repository_exists", "select repo_id, exists (select 1 from files f where f.repo_id = r.repo_id) as found from repositories r")
def _(t: Tables) -> DataFrame:
    held = t.files.select("repo_id", F.lit(True).alias("_f")).distinct()
    return t.repositories.select("repo_id").join(held, "repo_id", "left").select("repo_id", F.col("_f").isNotNull().alias("found"))


XML = "<a b='1'><c d='x'>t</c><c>u</c></a>"


@query("S36_xml_source", "select * from (values ('/a', 'a', '1', ''), ('/a/c', 'c', null, 't'), ('/a/c', 'c', null, 'u')) v(path, tag, b, text)")
def _(t: Tables) -> DataFrame:
    nodes = N.xml_nodes(t.spark.createDataFrame([("1", XML)], "k string, x string"), "k", "x")
    return nodes.select("path", "tag", F.try_element_at("attributes", F.lit("@_b")).alias("b"), "text")


@query("S44_generated_rows", "select i as id, ((i * 1664525 + 1013904223) % 4294967296) as value from range(1000) r(i)")
def _(t: Tables) -> DataFrame:
    return t.spark.range(1000).select("id", ((F.col("id") * 1664525 + 1013904223) % 4294967296).alias("value"))


#: The eight chunks of one provider and model that are nearest to the vector of the smallest id.
_RETRIEVED = """with v as (select chunk_id, max(embedding)::double[] as e from embedded_chunks where len(embedding) = 64 and provider = 'hashvec' and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0)) group by 1),
q as (select e from v order by chunk_id limit 1), c as (select chunk_id, max(relative_path) as path, max(start_line) as a, max(end_line) as b, max(content) as text from chunks where content is not null group by 1),
h as (select c.*, round(list_cosine_similarity(v.e, q.e), 9) as score from v, q, c where c.chunk_id = v.chunk_id),
k as (select *, row_number() over (order by score desc, chunk_id) as rank from h qualify rank <= 8)
"""


def _retrieved(t: Tables) -> DataFrame:
    e = t.embedded_chunks.where((F.size("embedding") == 64) & (F.col("provider") == "hashvec") & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0))
    v = e.groupBy("chunk_id").agg(F.max("embedding").alias("embedding"))
    question = v.orderBy("chunk_id").limit(1).first()
    c = t.chunks.where("content is not null").groupBy("chunk_id").agg(F.max("relative_path").alias("path"), F.max("start_line").alias("a"), F.max("end_line").alias("b"), F.max("content").alias("text"))
    if question is None:
        return c.limit(0).withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    scored = C.only(v, c, "chunk_id").withColumn("score", F.round(V.cosine(F.col("embedding"), V.literal([float(x) for x in question["embedding"]])), 9))
    best = R.top_k(scored, "score", 8, "chunk_id").select("chunk_id", "score")
    return c.join(F.broadcast(best), "chunk_id").withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))  # eight rows


_BLOCK = "'## ' || rank || '. ' || path || ' (' || a || '-' || b || ')' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10)"


def _block() -> F.Column:
    return R.context_block(F.col("rank"), F.col("path"), F.concat_ws("-", "a", "b"), F.lit(""), F.col("text"))


@query("R11_chat_retrieval", _RETRIEVED + f"select rank, chunk_id, {_BLOCK} as block from k")
def _(t: Tables) -> DataFrame:
    return _retrieved(t).select("rank", "chunk_id", _block().alias("block"))


@query("F31_prompt_context", _RETRIEVED + f"select string_agg({_BLOCK}, '' order by rank) as prompt from k")
def _(t: Tables) -> DataFrame:
    blocks = F.struct("rank", _block().alias("b"))
    return _retrieved(t).agg(F.array_join(F.transform(F.array_sort(F.collect_list(blocks)), lambda x: x["b"]), "").alias("prompt"))  # eight rows


@query("F42_source_slice", "select chunk_id, substr(content, 11, 30) as part, length(substr(content, 1, 10)) - length(replace(substr(content, 1, 10), chr(10), '')) + start_line as line from chunks where length(content) > 40")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("length(content) > 40").select("chunk_id", F.substring("content", 11, 30).alias("part"), (X.line_number(F.col("content"), F.lit(10)) - 1 + F.col("start_line")).alias("line"))


_DART = "import 'package:app/main.dart' as app;\nclass Cart extends Base {\n  int total(int x) {\n  }\n  factory Cart.empty() {\n  }\n}\n"


@query("K06_dart", "select * from (values ('imports', 'import', 'package:app/main.dart'), ('functions', 'method', 'total'), ('functions', 'factory', 'empty'), ('classes', 'class', 'Cart')) v(kind, type, name)")
def _(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(_DART,)], "c string")
    of = lambda k: rows.select(F.lit(k).alias("kind"), F.explode(N.symbols(F.col("c"), "dart", k)).alias("s")).select("kind", "s.type", "s.name")
    return of("imports").unionByName(of("functions")).unionByName(of("classes"))


@query("K10_between", "select doc_id, unnest(regexp_extract_all(text, '\\(([^()]*)\\)', 1)) as inner_text from documents where text is not null")
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"\(([^()]*)\)"), 1)).alias("inner_text"))


@query("K12_dispatch", "select case when regexp_matches(relative_path, '\\.(js|ts)$') then 'script' when ends_with(relative_path, '.py') then 'python' when ends_with(relative_path, '.java') then 'java' else 'other' end as analyzer, count(*) as n from chunks group by 1")
def _(t: Tables) -> DataFrame:
    lang = X.language(F.col("relative_path"))
    kind = F.when(lang.isin("javascript", "typescript"), "script").when(lang.isin("python", "java"), lang).otherwise("other")
    return t.chunks.groupBy(kind.alias("analyzer")).agg(F.count("*").alias("n"))


_FLOW = '<root><connections sourceNode="a" targetNode="b"/><connections sourceNode="b" targetNode="c"/></root>'


@query("K16_message_flow", "select * from (values ('connection', 'a', 'b'), ('connection', 'b', 'c')) v(type, source, target)")
def _(t: Tables) -> DataFrame:
    return L.relationships(t.spark.createDataFrame([("1", _FLOW, "xml")], "k string, c string, l string"), "k", "c", "l").select("type", "source", "target")


@query("K19_parse_cache", r"select chunk_id, len(regexp_extract_all(content, '(?m)^\s*import\s+([^\s#]+)(?:\s+as\s+(\w+))?')) + len(regexp_extract_all(content, '(?m)^\s*from\s+([^\s#]+)\s+import\s+([^#\n]+)')) as imports from chunks where content is not null and ends_with(relative_path, '.py')")
def _(t: Tables) -> DataFrame:
    # each different text is parsed once, however often it stands; what was parsed before would be read instead
    rows = t.chunks.where(F.col("content").isNotNull() & F.col("relative_path").endswith(".py")).select("chunk_id", "content", F.sha2("content", 256).alias("key"))
    parsed = rows.groupBy("key").agg(F.max("content").alias("content")).select("key", F.size(N.symbols(F.col("content"), "python", "imports")).alias("imports"))
    return rows.select("chunk_id", "key").join(parsed, "key").select("chunk_id", "imports")


@query("T11_chunk_stream", "select doc_id, i as chunk_no, length(substr(text, 3400 * i + 1, 4000)) as size from (select doc_id, text, unnest(range(0, 1 + greatest(0, ceil((length(text) - 4000) / 3400))::int)) as i from documents where length(text) > 0)")
def _(t: Tables) -> DataFrame:
    root = shared_folder(t.spark, "stream")
    rows = t.spark.readStream.schema(t.documents.schema).parquet(f"{t.base}/document[s].parquet")
    out = K.fixed_chunks(rows, "text").select("doc_id", "chunk_no", F.length("chunk").alias("size"))
    out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{root}/out")


@query("T12_embedding_errors", "select case when content is null then 'no text' when ceil(length(content) / 4) > 512 then 'over the token limit' end as error, count(*) as n from chunks group by 1")
def _(t: Tables) -> DataFrame:
    out = E.embedded(t.chunks, "chunk_id", "content", lambda: [E.HashEmbedder(max_tokens=512)])
    return out.groupBy("error").agg(F.count("*").alias("n"))


@query("T14_editor_debounce", "with g as (select *, case when ts - lag(ts) over (partition by event_type order by ts) < interval 1 minute then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by event_type order by ts rows unbounded preceding) as n from g) select event_type, min(ts) as start, count(*) as events from s group by event_type, n")
def _(t: Tables) -> DataFrame:
    e = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return W.debounced(e, "event_type", "ts", "1 minute").select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query("X07_strategy", "select event_type, case when avg(value) > 40 then 'small batches' when count(*) > 2000 then 'parallel' else 'default' end as strategy from events group by 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.when(F.avg("value") > 40, "small batches").when(F.count("*") > 2000, "parallel").otherwise("default").alias("strategy"))


_RECOVERY = {"RATE_LIMIT_EXCEEDED": "wait", "AUTHENTICATION_FAILED": "stop", "NETWORK_ERROR": "retry", "CONFIGURATION_ERROR": "stop", "UNKNOWN_ERROR": "retry"}
_CLASS = "case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{k}'" for k, p in X.ERROR_CLASSES) + " else 'UNKNOWN_ERROR' end"


@query("X08_recovery", f"select strategy, count(*) as n from (select case {_CLASS} " + " ".join(f"when '{k}' then '{v}'" for k, v in _RECOVERY.items()) + " end as strategy from documents where text is not null) group by 1")
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").groupBy(X.mapped(_RECOVERY, X.error_class(F.col("text"))).alias("strategy")).agg(F.count("*").alias("n"))


_GOOD = "with p as (select chunk_id, count(*) as n, max(content) as c from chunks group by 1), g as (select chunk_id from p where c is not null), v as (select * from embedded_chunks where chunk_id is not null) "


@query("M05_validate", _GOOD + "select (select count(*) from p where n > 1) as repeated, (select count(*) from p where c is null) as without_text, (select count(*) from v where chunk_id not in (select chunk_id from g)) as orphans, (select count(*) from g where chunk_id not in (select chunk_id from v)) as missing")
def _(t: Tables) -> DataFrame:
    return pipelines.repaired(t.chunks, t.embedded_chunks.where("chunk_id is not null"))[2]


@query("M05_repair", _GOOD + "select chunk_id, vec_id from v where chunk_id in (select chunk_id from g)")
def _(t: Tables) -> DataFrame:
    return pipelines.repaired(t.chunks, t.embedded_chunks.where("chunk_id is not null"))[1].select("chunk_id", "vec_id")


@query("M08_provider_benchmark", "select event_type, round(avg(value), 6) as latency, count(*) as requests, round(count(*) filter (value < 60) / count(*), 6) as reliability, round(coalesce(corr(value, event_id), 0), 6) as scalability from events group by 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("latency"), F.count("*").alias("requests"), F.round(F.count_if(F.col("value") < 60) / F.count("*"), 6).alias("reliability"), F.round(M.correlation("value", "event_id"), 6).alias("scalability")
    )


@query("M11_fallback_used", "select chunk_id as key, case when content is not null and length(content) <= 32768 then 'hash' end as provider from chunks")
def _(t: Tables) -> DataFrame:
    return E.embedded(t.chunks, "chunk_id", "content", lambda: [E.Unavailable(), E.HashEmbedder()]).select("key", "provider")


@query("M12_reindex_marks", "select model_version, bool_or(len(embedding) is distinct from 64) as needs from embedded_chunks group by 1")
def _(t: Tables) -> DataFrame:
    dims = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return t.embedded_chunks.groupBy("model_version").agg(F.bool_or(~dims.eqNullSafe(F.lit(64))).alias("needs"))


@query("Y02_bulk_hashes", "select chunk_id, sha256(content) as hash, length(content) as size from (select distinct chunk_id, content from chunks where content is not null)")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", "content").distinct().select("chunk_id", F.sha2("content", 256).alias("hash"), F.length("content").alias("size"))


@query("Y03_optimised_changes", _STATES + "select coalesce(n.path, o.path) as path, case when o.path is null then 'added' when n.path is null then 'deleted' when n.size is not distinct from o.size and n.last_modified is not distinct from o.last_modified then 'unchanged' when o.hash = n.hash then 'unchanged' else 'modified' end as change from n full join o on n.path = o.path")
def _(t: Tables) -> DataFrame:
    old, new = _states(t)
    stat = C.stat_check(old, new)
    known = stat.where("state = 'unchanged'").select("path", F.lit("unchanged").alias("change"))
    rest = C.changes(C.without(old, known, "path"), C.without(new, known, "path"))  # only these need their hash
    return known.unionByName(rest)


@query("Y06_sampled_validation")
def _(t: Tables) -> DataFrame:
    old, new = _states(t)
    some = old.orderBy(F.xxhash64("path", F.lit(5)), "path").limit(20)
    return C.hash_check(some, new)


@query("Y11_technology_ranking", _TECH + "select repo_id, technology from g qualify row_number() over (partition by repo_id order by confidence * (1 + ln(detections)) desc, technology) <= 2")
def _(t: Tables) -> DataFrame:
    out = P.technologies(t.files, "repo_id", F.col("relative_path"), F.col("extension"))
    return R.top_k_per(out, "repo_id", "score", 2, "technology").select("repo_id", "technology")


@query("Y12_ending_technologies", "select repo_id, technology, count(*) as n from (select repo_id, case lower(extension) " + " ".join(f"when '{e}' then '{n}'" for e, n in P.ENDING_TECHNOLOGIES.items()) + " end as technology from files) where technology is not null group by all")
def _(t: Tables) -> DataFrame:
    return t.files.groupBy("repo_id", X.mapped(P.ENDING_TECHNOLOGIES, F.lower("extension")).alias("technology")).agg(F.count("*").alias("n")).where("technology is not null")


@query("Y18_storage_statistics", "select provider, count(*) as vectors, sum(len(embedding) * 4)::bigint as bytes from embedded_chunks group by 1")
def _(t: Tables) -> DataFrame:
    return t.embedded_chunks.groupBy("provider").agg(F.count("*").alias("vectors"), F.sum(F.when(F.col("embedding").isNotNull(), F.size("embedding") * 4)).alias("bytes"))


@query("Y26_recommended_provider", "with a as (select event_type, avg(value) as v, count(*) as n from events group by 1) select arg_min(event_type, (v, event_type)) as latency, arg_max(event_type, (n, event_type)) as throughput from a")
def _(t: Tables) -> DataFrame:
    a = t.events.groupBy("event_type").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return a.agg(F.min_by("event_type", F.struct("v", "event_type")).alias("latency"), F.max_by("event_type", F.struct("n", "event_type")).alias("throughput"))


@query("Y29_history_kept", "select user_id, event_id from events qualify row_number() over (partition by user_id order by event_id desc) <= 30")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return t.events.select("user_id", "event_id").withColumn("_n", F.row_number().over(w)).where("_n <= 30").drop("_n")


@query("Y31_best_configuration", "with b as (select json_extract_string(props, '$.k')::int % 7 as config, avg(value) as v from events group by 1) select arg_max(config, (v, -config)) as best, arg_min(config, (v, config)) as worst from b")
def _(t: Tables) -> DataFrame:
    b = t.events.groupBy((F.get_json_object("props", "$.k").cast("int") % 7).alias("config")).agg(F.avg("value").alias("v"))
    return b.agg(F.max_by("config", F.struct("v", -F.col("config"))).alias("best"), F.min_by("config", F.struct("v", "config")).alias("worst"))


@query("Y33_error_table", f"select lang, {_CLASS} as class, count(*) as n from documents where text is not null group by all")
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").groupBy("lang", X.error_class(F.col("text")).alias("class")).agg(F.count("*").alias("n"))


@query("Y35_health_report", "with a as (select event_type, 100.0 * count(*) filter (value < 60) / count(*) as up from events group by 1) select event_type, round(up, 6) as up, case when up > 90 then 'healthy' when up > 70 then 'degraded' else 'unhealthy' end as status from a")
def _(t: Tables) -> DataFrame:
    a = t.events.groupBy("event_type").agg(M.rate(F.count_if(F.col("value") < 60), F.count("*")).alias("up"))
    return a.select("event_type", F.round("up", 6).alias("up"), F.when(F.col("up") > 90, "healthy").when(F.col("up") > 70, "degraded").otherwise("unhealthy").alias("status"))


@query("Y39_history_peak", "select event_type, max(value) as peak, round(avg(value), 6) as average from (select * from events qualify row_number() over (partition by event_type order by event_id desc) <= 1000) group by 1")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy(F.desc("event_id"))
    last = t.events.withColumn("_n", F.row_number().over(w)).where("_n <= 1000")
    return last.groupBy("event_type").agg(F.max("value").alias("peak"), F.round(F.avg("value"), 6).alias("average"))


@query(
    "Y15_enriched_chunks",
    f"""with m as (select chunk_id, content, {_some('java', 'functions')} as functions, {_some('java', 'classes')} as classes, {_some('java', 'imports')} as imports, {_some('java', 'comments')} as comments from chunks where content is not null and ends_with(relative_path, '.java'))
select chunk_id, case when functions > 0 then 'function' when classes > 0 then 'class' when imports > 0 then 'import' when comments > 0 then 'comment' else 'code' end as kind, functions, classes, comments,
  list_filter(string_split_regex(lower('{NAMED}'), '\\s+'), lambda w: length(w) > 2 and contains(lower(content), w)) as words from m""",
)
def _(t: Tables) -> DataFrame:
    rows = t.chunks.where(F.col("content").isNotNull() & F.col("relative_path").endswith(".java"))
    return N.structure(rows, "content", "java").select("chunk_id", "kind", F.size("functions").alias("functions"), F.size("classes").alias("classes"), F.size("comments").alias("comments"), R.partial_matches(F.col("content"), F.lit(NAMED)).alias("words"))
