"""Aggregates, windows, summaries and streaming: queries and SQL. Events stand for a metric log: event_type is the provider,
value the response time, an error a failure, props.k the batch size."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarryline.functions import text as X
from quarryline.functions import vectors as V
from quarryline.operators import metrics as M
from quarryline.operators import retrieval as R
from quarryline.operators import summary as P
from quarryline.plans.reference_scan import _LOC, _LANG, _quoted
from quarryline.plans.registry import Registry, Tables
from quarryline.sources.tables import shared_folder
from quarryline.streaming import watch as W

query = Registry()
_K = "json_extract_string(props, '$.k')::int"


def ok() -> Column:
    return F.col("event_type") != "error"


def _events(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("A01_run_totals", "select count(*) as files, count(distinct hash) as contents, sum(size)::bigint as bytes from files")
def _(t: Tables) -> DataFrame:
    return t.files.agg(F.count("*").alias("files"), F.countDistinct("hash").alias("contents"), F.sum("size").alias("bytes"))


@query("A02_per_provider", "select coalesce(provider, 'unknown') as provider, count(*) as n from embedded_chunks group by 1")
def _(t: Tables) -> DataFrame:
    return t.embedded_chunks.groupBy(F.coalesce("provider", F.lit("unknown")).alias("provider")).agg(F.count("*").alias("n"))


@query("A03_index_statistics", "select model_version, count(*) as n, max(len(embedding)) as dims, (count(*) * max(len(embedding)) * 4)::bigint as bytes from embedded_chunks group by 1")
def _(t: Tables) -> DataFrame:
    n, dims = F.count("*"), F.max(F.when(F.col("embedding").isNotNull(), F.size("embedding")))
    return t.embedded_chunks.groupBy("model_version").agg(n.alias("n"), dims.alias("dims"), (n * dims * 4).cast("long").alias("bytes"))


@query("A04_integrity", "select chunk_id, count(*) as copies from chunks group by 1 having count(*) > 1")
def _(t: Tables) -> DataFrame:
    return t.chunks.groupBy("chunk_id").agg(F.count("*").alias("copies")).where("copies > 1")


@query("A05_file_statistics", "select repo_id, lower(regexp_extract(relative_path, '(\\.[^./]*)$', 1)) as extension, count(*) as files, sum(size)::bigint as bytes, round(avg(size), 4) as average, count(*) filter (mime_type like 'text/%') as texts from files group by all")
def _(t: Tables) -> DataFrame:
    return t.files.groupBy("repo_id", X.ending(F.col("relative_path")).alias("extension")).agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.round(F.avg("size"), 4).alias("average"), F.count_if(F.col("mime_type").like("text/%")).alias("texts")
    )


@query("A06_repository_statistics", "with f as (select repo_id, count(distinct file_id) as files from files group by 1), c as (select repo_id, count(distinct chunk_id) as chunks from chunks group by 1) select alias, files, chunks from repositories join f using (repo_id) join c using (repo_id)")
def _(t: Tables) -> DataFrame:
    f = t.files.groupBy("repo_id").agg(F.countDistinct("file_id").alias("files"))
    c = t.chunks.groupBy("repo_id").agg(F.countDistinct("chunk_id").alias("chunks"))
    return t.repositories.join(f, "repo_id").join(c, "repo_id").select("alias", "files", "chunks")


@query("A07_directory_size", "select repo_id, sum(size)::bigint as bytes, count(*) as files, max(last_modified) as newest from files group by 1")
def _(t: Tables) -> DataFrame:
    return t.files.groupBy("repo_id").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"), F.max("last_modified").alias("newest"))


@query("A08_chunk_statistics", "select repo_id, count(content) as chunks, sum(length(content))::bigint as chars, round(avg(length(content)), 4) as average, min(length(content)) as least, max(length(content)) as most, sum(ceil(length(content) / 4)::int)::bigint as tokens from chunks group by 1")
def _(t: Tables) -> DataFrame:
    n = F.length("content")
    return t.chunks.groupBy("repo_id").agg(F.count("content").alias("chunks"), F.sum(n).alias("chars"), F.round(F.avg(n), 4).alias("average"), F.min(n).alias("least"), F.max(n).alias("most"), F.sum(X.tokens_estimated(F.col("content"))).alias("tokens"))


_LOCS = f"select repo_id, relative_path, {_LANG} as language, {_LOC.replace(chr(123) + '0' + chr(125), '')} as loc from chunks where content is not null"


def _locs(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("repo_id", "relative_path", X.display_language(F.col("relative_path")).alias("language"), X.code_lines(F.col("content")).alias("loc"))


@query("A09_language_distribution", f"select repo_id, language, sum(loc)::bigint as loc from ({_LOCS}) group by all")
def _(t: Tables) -> DataFrame:
    return _locs(t).groupBy("repo_id", "language").agg(F.sum("loc").alias("loc"))


@query("A10_primary_language", f"select repo_id, language from (select repo_id, language, sum(loc) as loc from ({_LOCS}) group by all) qualify row_number() over (partition by repo_id order by loc desc, language) = 1")
def _(t: Tables) -> DataFrame:
    return P.primary(_locs(t).groupBy("repo_id", "language").agg(F.sum("loc").alias("loc")), "repo_id", "language", "loc")


_KIND = "case " + " ".join(f"when regexp_matches(lower(directory), '{p}') then '{k}'" for k, p in P.DIRECTORY_KINDS) + " else 'source' end"
_ROLLUP = f"""select repo_id, directory, count(*) as files, len(string_split(directory, '/')) as depth, {_KIND} as kind from (
  select repo_id, unnest(list_transform(range(1, len(p)), lambda i: array_to_string(p[1:i], '/'))) as directory from (select repo_id, string_split(relative_path, '/') as p from files)) group by all"""


@query("A11_directory_rollup", _ROLLUP)
def _(t: Tables) -> DataFrame:
    return P.directory_rollup(t.files, "repo_id", "relative_path")


@query("A12_directory_depth", f"select repo_id, max(depth) as depth from ({_ROLLUP}) group by 1")
def _(t: Tables) -> DataFrame:
    return P.directory_rollup(t.files, "repo_id", "relative_path").groupBy("repo_id").agg(F.max("depth").alias("depth"))


@query("M07_directory_tree", f"select repo_id, directory, nullif(regexp_replace(directory, '/?[^/]*$', ''), '') as parent, depth, kind from ({_ROLLUP})")
def _(t: Tables) -> DataFrame:
    tree = P.directory_rollup(t.files, "repo_id", "relative_path")
    return tree.select("repo_id", "directory", F.nullif(F.regexp_replace("directory", "/?[^/]*$", ""), F.lit("")).alias("parent"), "depth", "kind")


@query(
    "A13_project_score",
    f"""with l as ({_LOCS}), a as (select repo_id, count(distinct relative_path) as files, sum(loc) as loc, count(distinct language) as languages from l group by 1),
d as (select repo_id, max(depth) as depth from ({_ROLLUP}) group by 1)
select repo_id, least(10, greatest(1, floor(least(files / 100, 3) + least(loc / 10000, 3) + least(languages / 3, 2) + least(depth / 5, 2) + 0.5)))::int as score from a join d using (repo_id)""",
)
def _(t: Tables) -> DataFrame:
    a = _locs(t).groupBy("repo_id").agg(F.countDistinct("relative_path").alias("files"), F.sum("loc").alias("loc"), F.countDistinct("language").alias("languages"))
    d = P.directory_rollup(t.files, "repo_id", "relative_path").groupBy("repo_id").agg(F.max("depth").alias("depth"))
    return a.join(d, "repo_id").select("repo_id", P.project_score(F.col("files"), F.col("loc"), F.col("languages"), F.col("depth")).alias("score"))


@query("A14_change_ratio", r"select repo_id, round(count(*) filter (regexp_matches(relative_path, 'package\.json$|(?i:README)|(?i:config)|\.(js|ts|py|java|cpp|c|cs)$')) / count(*), 6) as ratio from files group by 1")
def _(t: Tables) -> DataFrame:
    from quarryline.operators.changes import significant

    return t.files.groupBy("repo_id").agg(F.round(F.try_divide(F.count_if(significant(F.col("relative_path"))), F.count("*")), 6).alias("ratio"))


_TECH_RULES = ", ".join(f"('{t}', '{n.lower()}')" for t, names in P.FILE_TECHNOLOGIES.items() for n in names)
_TECH_ENDS = ", ".join(f"('{t}', '{e}')" for e, t in P.ENDING_TECHNOLOGIES.items())
_TECH = f"""with r(technology, part) as (values {_TECH_RULES}), x(technology, ending) as (values {_TECH_ENDS}),
h as (select repo_id, technology, 'file-pattern' as source, 0.8 as confidence from files join r on contains(lower(relative_path), part)
  union all select repo_id, technology, 'extension', 0.6 from files join x on lower(extension) = ending),
g as (select repo_id, technology, max(confidence)::double as confidence, count(*) as detections, array_to_string(list_sort(list(distinct source)), ',') as sources from h group by all)
"""


@query("A15_technologies", _TECH + "select repo_id, technology, confidence, detections, sources, round(confidence * (1 + ln(detections)), 6) as score from g")
def _(t: Tables) -> DataFrame:
    out = P.technologies(t.files, "repo_id", F.col("relative_path"), F.col("extension"))
    return out.select("repo_id", "technology", "confidence", "detections", F.array_join("sources", ",").alias("sources"), F.round("score", 6).alias("score"))


_CATEGORY = "case technology " + " ".join(f"when '{k}' then '{v}'" for k, v in P.CATEGORIES.items()) + " else 'Other' end"


@query("A16_categories", _TECH + f"select {_CATEGORY} as category, count(distinct technology) as technologies from g group by 1")
def _(t: Tables) -> DataFrame:
    out = P.technologies(t.files, "repo_id", F.col("relative_path"), F.col("extension"))
    return out.groupBy(P.category(F.col("technology")).alias("category")).agg(F.countDistinct("technology").alias("technologies"))


_CONTENT = ", ".join(f"case when regexp_matches(content, '{'' if p in P.CASED else '(?i)'}{_quoted(p)}') then '{t}' end" for t, patterns in P.CONTENT_TECHNOLOGIES.items() for p in patterns)


#: Written out, so that a pattern missing above is seen.
_TEN = ("react", r"(?i)import.*react|(?i)from [''\"]react[''\"]|React\.|(?i)jsx"), ("material-ui", "(?i)@mui|@material-ui"), ("gcp", r"(?i)google-cloud|from google\.cloud"), ("zustand", r"(?i)zustand|create\("), ("mobx", "(?i)mobx|@observable|@action"), ("msgflow", r"(?i)<\?xml|<MessageFlow|<ComputeNode|<FilterNode|<MQInput"), ("mulesoft", r"(?i)<mule|xmlns:mule|<flow\s+name|<http:listener|<db:select"), ("dataweave", r"(?i)output\s+application/json|input\s+payload|%dw\s+2\.0|mapObject|---"), ("flutter", r"(?i)import\s+''package:flutter|extends\s+StatelessWidget|extends\s+StatefulWidget|MaterialApp"), ("cloudformation", r"(?i:AWSTemplateFormatVersion|Resources:|Type:\s+AWS::)|!Ref\s")


@query("F37_repositories_by_content", "select technology, count(*) as repositories from (select distinct repo_id, technology from (select repo_id, unnest([" + ", ".join(f"case when regexp_matches(content, '{p}') then '{t}' end" for t, p in _TEN) + "]) as technology from chunks where content is not null) where technology is not null) group by 1")
def _(t: Tables) -> DataFrame:
    found = P.content_technologies(t.chunks.where("content is not null"), "repo_id", "content")
    return found.where(F.col("technology").isin(*[k for k, _ in _TEN])).groupBy("technology").agg(F.count("*").alias("repositories"))


@query("F37_content_technologies", f"select repo_id, technology, count(*) as detections from (select repo_id, unnest(list_filter([{_CONTENT}], lambda x: x is not null)) as technology from chunks where content is not null) group by all")
def _(t: Tables) -> DataFrame:
    return P.content_technologies(t.chunks.where("content is not null"), "repo_id", "content").select("repo_id", "technology", "detections")


_P = "lower(relative_path)"


@query(
    "A17_architecture",
    f"""with a as (select repo_id, bool_or(contains({_P}, 'model')) and bool_or(contains({_P}, 'view')) and bool_or(contains({_P}, 'controller')) as mvc,
  count(*) filter (contains({_P}, 'service') or contains({_P}, 'api')) > 3 as microservices,
  {' + '.join(f"bool_or(contains({_P}, '{x}'))::int" for x in P.LAYERS)} >= 3 as layered,
  count(distinct case when len(string_split(relative_path, '/')) > 2 then split_part(relative_path, '/', 2) end) > 3 as modular from files group by 1)
select *, (mvc::int + microservices::int + layered::int + modular::int) * 25 as confidence from a""",
)
def _(t: Tables) -> DataFrame:
    return P.architecture(t.files, "repo_id", F.col("relative_path"))


@query("P13_directory_kind", f"select distinct directory, {_KIND} as kind from (select distinct directory from ({_ROLLUP}))")
def _(t: Tables) -> DataFrame:
    return P.directory_rollup(t.files, "repo_id", "relative_path").select("directory", "kind").distinct()


# ------------------------------------------------------------------ metrics


@query("A18_counters", "select event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as average, min(value) as least, max(value) as most, arg_max(event_id, (value, event_id)) as slowest, arg_min(event_id, (value, event_id)) as quickest from events group by 1")
def _(t: Tables) -> DataFrame:
    at = F.struct("value", "event_id")
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("average"), F.min("value").alias("least"), F.max("value").alias("most"), F.max_by("event_id", at).alias("slowest"), F.min_by("event_id", at).alias("quickest")
    )


@query("A19_rates", "select user_id, count(*) as n, round(100.0 * count(*) filter (event_type <> 'error') / count(*), 6) as success_rate, round(100.0 * count(*) filter (event_type = 'error') / count(*), 6) as error_rate from events group by 1")
def _(t: Tables) -> DataFrame:
    out = M.run_totals(t.events, ["user_id"], "value", ok())
    return out.select("user_id", F.col("total").alias("n"), F.round("success_rate", 6).alias("success_rate"), F.round("error_rate", 6).alias("error_rate"))


@query("A20_operation_timing", "select split_part(event_type || '_' || user_id, '_', 1) as operation, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as average from events group by 1")
def _(t: Tables) -> DataFrame:
    op = F.split_part(F.concat("event_type", F.lit("_"), F.col("user_id").cast("string")), F.lit("_"), F.lit(1))
    return t.events.groupBy(op.alias("operation")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("average"))


@query("A21_completion", "select strftime(ts, '%Y-%m-%d') as day, count(*) as n, count(*) filter (event_type = 'error') as failed, round(100.0 * count(*) filter (event_type <> 'error') / count(*), 6) as rate from events group by 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(~ok()).alias("failed"), F.round(M.rate(F.count_if(ok()), F.count("*")), 6).alias("rate"))


@query("A22_recommendations", "with a as (select event_type, avg(value) as v, count(*) as n from events group by 1) select event_type, unnest(list_filter([case when v > 40 then 'slow' end, case when n > 1500 then 'busy' end, case when event_type = 'error' then 'failing' end], lambda x: x is not null)) as advice from a")
def _(t: Tables) -> DataFrame:
    a = t.events.groupBy("event_type").agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    advice = F.filter(F.array(F.when(F.col("v") > 40, "slow"), F.when(F.col("n") > 1500, "busy"), F.when(F.col("event_type") == "error", "failing")), lambda x: x.isNotNull())
    return a.select("event_type", F.explode(advice).alias("advice"))


_SORTED = "with s as (select event_type, list_sort(list(value)) as v from events where value is not null group by 1) "


@query("A23_descriptive", _SORTED + "select e.event_type, round(avg(value), 6) as mean, min(value) as min, max(value) as max, round(stddev_pop(value), 6) as deviation, any_value(v[len(v) // 2 + 1]) as median, any_value(v[floor(0.95 * len(v))::int + 1]) as p95 from events e join s using (event_type) group by 1")
def _(t: Tables) -> DataFrame:
    out = M.descriptive(t.events, ["event_type"], "value")
    return out.select("event_type", F.round("mean", 6).alias("mean"), "min", "max", F.round("deviation", 6).alias("deviation"), "median", "p95")


@query("A24_percentiles", _SORTED + "select event_type, v[floor(0.5 * len(v))::int + 1] as p50, v[floor(0.9 * len(v))::int + 1] as p90, v[floor(0.95 * len(v))::int + 1] as p95, v[floor(0.99 * len(v))::int + 1] as p99 from s")
def _(t: Tables) -> DataFrame:
    return M.ranked_statistics(t.events, ["event_type"], "value", {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}).drop("n")


@query("A25_true_median", "select event_type, round(median(value), 6) as median from events group by 1")
def _(t: Tables) -> DataFrame:
    return M.medians(t.events, ["event_type"], "value").select("event_type", F.round("median", 6).alias("median"))


@query("A26_benchmark", f"select {_K} % 5 as config, count(*) as n, round(avg(value), 6) as average, min(value) as least, max(value) as most, round(count(*) filter (event_type = 'error') / count(*), 6) as error_rate from events group by 1")
def _(t: Tables) -> DataFrame:
    return _events(t).groupBy((F.col("k") % 5).alias("config")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("average"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.count_if(~ok()) / F.count("*"), 6).alias("error_rate"))


@query("A27_correlation", f"select event_type, round(coalesce(corr(value, {_K}), 0), 6) as r from events group by 1")
def _(t: Tables) -> DataFrame:
    return _events(t).groupBy("event_type").agg(F.round(M.correlation("value", "k"), 6).alias("r"))


@query("A28_variance", "select event_type, round(var_pop(value), 4) as variance from events group by 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.var_pop("value"), 4).alias("variance"))


@query("A29_stability", "with l as (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5), s as (select user_id, greatest(0, 1 - stddev_pop(value) / avg(value)) as score from l group by 1 having avg(value) <> 0) select user_id, round(score, 6) as score, case when score > 0.8 then 'stable' when score > 0.6 then 'moderate' else 'unstable' end as label from s")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = t.events.withColumn("_n", F.row_number().over(w)).where("_n <= 5").groupBy("user_id").agg(F.greatest(F.lit(0.0), 1 - F.try_divide(F.stddev_pop("value"), F.avg("value"))).alias("score"), F.avg("value").alias("a")).where("a <> 0")
    return last.select("user_id", F.round("score", 6).alias("score"), F.when(F.col("score") > 0.8, "stable").when(F.col("score") > 0.6, "moderate").otherwise("unstable").alias("label"))


@query("A30_best_batch", f"with b as (select event_type, {_K} as k, avg(value) as v, count(*) as n from events group by all having count(*) >= 5) select event_type, k from b qualify row_number() over (partition by event_type order by v desc, k) = 1")
def _(t: Tables) -> DataFrame:
    b = _events(t).groupBy("event_type", "k").agg(F.avg("value").alias("v"), F.count("*").alias("n")).where("n >= 5")
    return b.groupBy("event_type").agg(F.max_by("k", F.struct("v", -F.col("k"))).alias("k"))


@query("A32_best_provider", "with a as (select event_type, avg(value) as v from events group by 1) select arg_min(event_type, (v, event_type)) as quickest, arg_max(event_type, (v, event_type)) as slowest from a")
def _(t: Tables) -> DataFrame:
    a = t.events.groupBy("event_type").agg(F.avg("value").alias("v"))
    return a.agg(F.min_by("event_type", F.struct("v", "event_type")).alias("quickest"), F.max_by("event_type", F.struct("v", "event_type")).alias("slowest"))


@query("A33_comparison", "select (user_id % 10)::bigint as shard, " + ", ".join(f"round(avg(value) filter (event_type = '{k}'), 6) as \"{k}\"" for k in ("click", "error", "purchase", "signup", "view")) + " from events group by 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy((F.col("user_id") % 10).alias("shard")).pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.round(F.avg("value"), 6))


@query("A35_intra_cluster", "select a.label, round(avg(list_cosine_similarity(a.embedding::double[], b.embedding::double[])), 6) as similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id group by 1")
def _(t: Tables) -> DataFrame:
    # the mean over pairs from sums: |sum of unit vectors|^2 = n + 2 * sum over pairs, so no pairs are formed
    unit = t.embeddings.select("label", "vec_id", F.posexplode(F.transform("embedding", lambda x: x.cast("double") / V.norm(F.col("embedding")))).alias("d", "x"))
    sums = unit.groupBy("label", "d").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    per = sums.groupBy("label").agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"), F.max("n").alias("n")).where("n > 1")
    return per.select("label", F.round((F.col("s2") - F.col("q")) / (F.col("n") * (F.col("n") - 1)), 6).alias("similarity"))


@query("A36_dimensionality", "select label, max(len(embedding)) as dims, round(avg(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))), 6) as norm, round(avg(len(list_filter(embedding, lambda x: abs(x::double) < 0.001)) / len(embedding)), 6) as sparsity from embeddings group by 1")
def _(t: Tables) -> DataFrame:
    sparse = F.size(F.filter("embedding", lambda x: F.abs(x.cast("double")) < 0.001)) / F.size("embedding")
    return t.embeddings.groupBy("label").agg(F.max(F.size("embedding")).alias("dims"), F.round(F.avg(V.norm(F.col("embedding"))), 6).alias("norm"), F.round(F.avg(sparse), 6).alias("sparsity"))


@query("A37_consistency", "with p as (select label, list_cosine_similarity(embedding::double[], lag(embedding) over (partition by label order by vec_id)::double[]) as c from embeddings) select label, round(avg(c), 6) as average, round(min(c), 6) as least, round(max(c), 6) as most from p group by 1")
def _(t: Tables) -> DataFrame:
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    p = t.embeddings.select("label", "embedding", before.alias("before")).withColumn("c", V.cosine(F.col("embedding"), F.col("before")))
    return p.groupBy("label").agg(F.round(F.avg("c"), 6).alias("average"), F.round(F.min("c"), 6).alias("least"), F.round(F.max("c"), 6).alias("most"))


@query("A38_recent_means", "select user_id, round(avg(value), 6) as recent from (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 10) group by 1")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.events.withColumn("_n", F.row_number().over(w)).where("_n <= 10").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("recent"))


@query("A39_provider_score", "with a as (select event_type, avg(value) as v, count(*) / 30.0 as th, count(*) filter (event_type <> 'error') / count(*) as re from events group by 1) select event_type, round((0.4 / (1 + v / 1000) + 0.4 * least(th / 100, 1) + 0.2 * re) / 1.0, 6) as score from a")
def _(t: Tables) -> DataFrame:
    a = t.events.groupBy("event_type").agg(F.avg("value").alias("v"), (F.count("*") / 30.0).alias("th"), (F.count_if(ok()) / F.count("*")).alias("re"))
    return a.select("event_type", F.round(M.provider_score(F.col("v"), F.col("th"), F.col("re")), 6).alias("score"))


@query("A40_health_score", "with a as (select event_type, avg(value) as v, count(*) filter (value > 140) as f from events group by 1) select event_type, round(greatest(0, 100 + 10 * 2 - 20 * least(f, 4) - case when f > 2 then 50 else 0 end + greatest(0, 50 - v / 100) - case when event_type = 'error' then 100 else 0 end), 6) as score from a")
def _(t: Tables) -> DataFrame:
    a = t.events.groupBy("event_type").agg(F.avg("value").alias("v"), F.count_if(F.col("value") > 140).alias("f"))
    score = M.health_score(F.lit(2.0), F.least(F.col("f"), F.lit(4)), F.col("f") > 2, F.col("v"), F.col("event_type") == "error")
    return a.select("event_type", F.round(score, 6).alias("score"))


@query("A42_error_counts", "select event_type, user_id % 4 as provider, count(*) as n from events group by grouping sets ((event_type), (user_id % 4), ())")
def _(t: Tables) -> DataFrame:
    rows = t.events.select("event_type", (F.col("user_id") % 4).alias("provider"))
    return rows.groupingSets([["event_type"], ["provider"], []], "event_type", "provider").agg(F.count("*").alias("n"))


@query("A44_memory_statistics", "select date_trunc('hour', ts) as hour, max(value) as peak, round(avg(value), 6) as mean, count(*) filter (value > 70 and value <= 100) as warnings, count(*) filter (value > 100) as critical from events group by 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.max("value").alias("peak"), F.round(F.avg("value"), 6).alias("mean"), F.count_if((F.col("value") > 70) & (F.col("value") <= 100)).alias("warnings"), F.count_if(F.col("value") > 100).alias("critical"))


# ------------------------------------------------------------------ windows


@query("W02_moving_average", "select event_id, round(avg(value) over (partition by event_type order by ts, event_id rows between 9 preceding and current row), 6) as average from events")
def _(t: Tables) -> DataFrame:
    return M.moving_average(t.events, "event_type", ["ts", "event_id"], "value", 10, "average").select("event_id", F.round("average", 6).alias("average"))


_RUNS = """with s as (select *, value > 40 as slow from events where value is not null), c as (select *, case when slow is not distinct from lag(slow) over (partition by event_type order by ts, event_id) then 0 else 1 end as ch from s),
i as (select *, sum(ch) over (partition by event_type order by ts, event_id rows unbounded preceding) as isl from c)
select event_id, slow as state, row_number() over (partition by event_type, isl order by ts, event_id) as run from i"""


@query("W03_run_lengths", _RUNS)
def _(t: Tables) -> DataFrame:
    return M.run_lengths(t.events.where("value is not null"), "event_type", ["ts", "event_id"], F.col("value") > 40).select("event_id", "state", "run")


@query(
    "W05_trend",
    """with w as (select event_id, avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) as r, avg(value) over (partition by user_id order by ts, event_id rows between 5 preceding and 3 preceding) as p from events)
select event_id, case when p is null or p = 0 then 'unknown' when r / p < 0.95 then 'falling' when r / p < 0.98 then 'easing' else 'steady' end as trend from w""",
)
def _(t: Tables) -> DataFrame:
    return M.trend(t.events, "user_id", ["ts", "event_id"], "value").select("event_id", "trend")


@query("W06_eta", "select event_id, round((1000 - row_number() over (partition by event_type order by ts, event_id)) * avg(value) over (partition by event_type order by ts, event_id rows between 19 preceding and current row), 4) as eta from events")
def _(t: Tables) -> DataFrame:
    return M.over_last(t.events, "event_type", ["ts", "event_id"], 20, {"pace": F.avg("value")}).select("event_id", F.round((999 - F.col("_pos")) * F.col("pace"), 4).alias("eta"))


@query("W07_rate_window", "select event_id, count(*) over w as requests, round(sum(value) over w, 4) as amount from events window w as (partition by user_id order by ts range between interval 1 hour preceding and current row)")
def _(t: Tables) -> DataFrame:
    return M.sliding_counts(_events(t), "user_id", "ts", "value", 3600).select("event_id", "requests", F.round("amount", 4).alias("amount"))


@query("W10_health_runs", _RUNS.replace("value > 40 as slow", "value > 60 as slow").replace("select event_id, slow as state", "select event_id, slow and row_number() over (partition by event_type, isl order by ts, event_id) >= 3 as unhealthy, slow as state"))
def _(t: Tables) -> DataFrame:
    out = M.run_lengths(t.events.where("value is not null"), "event_type", ["ts", "event_id"], F.col("value") > 60)
    return out.select("event_id", (F.col("state") & (F.col("run") >= 3)).alias("unhealthy"), "state", "run")


@query("Y24_wait", "select event_id, ((epoch_us(min(ts) over w) + 3600000000 - epoch_us(ts)) // 1000)::bigint as wait_ms from events window w as (partition by user_id order by ts range between interval 1 hour preceding and current row)")
def _(t: Tables) -> DataFrame:
    return M.sliding_counts(_events(t), "user_id", "ts", "value", 3600).select("event_id", "wait_ms")


@query("O06_eviction", "select repo_id, file_id, hash, sum(size) over (partition by repo_id order by last_modified desc, file_id desc, hash desc rows unbounded preceding)::bigint as kept_size from (select distinct repo_id, file_id, hash, size, last_modified from files where size is not null)")
def _(t: Tables) -> DataFrame:
    rows = t.files.where("size is not null").select("repo_id", "file_id", "hash", "size", "last_modified").distinct()
    return M.evictions(rows, "repo_id", ["last_modified", "file_id", "hash"], "size", 20_000).select("repo_id", "file_id", "hash", "kept_size")


@query("O_asof_nearest", "select e.event_id, (select max(x.event_id) from events x where x.event_type = 'error' and x.ts between e.ts - interval 5 second and e.ts + interval 5 second) as near from events e where e.event_type = 'purchase'")
def _(t: Tables) -> DataFrame:
    # nearest record within 5 s: both sides are cut into 10 s buckets, so the join is an equality join on the bucket
    e = _events(t)
    bucket = F.floor(F.unix_micros("ts") / 10_000_000)
    left = e.where("event_type = 'purchase'").select("event_id", F.unix_micros("ts").alias("at"), bucket.alias("b"))
    right = e.where("event_type = 'error'").select(F.col("event_id").alias("other"), F.unix_micros("ts").alias("when"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b"))
    hits = left.join(right, "b").where(F.abs(F.col("at") - F.col("when")) <= 5_000_000).groupBy("event_id").agg(F.max("other").alias("near"))
    return left.select("event_id").join(hits, "event_id", "left")


# ------------------------------------------------------------------ streaming


@query(
    "T01_sessions",
    "with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g) select user_id, min(ts) as start, count(*) as events from s group by user_id, n",
)
def _(t: Tables) -> DataFrame:
    return W.debounced(_events(t), "user_id", "ts", "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "events")


@query("T15_tumbling", "select event_type, time_bucket(interval 1 hour, ts) as start, count(*) as events, round(sum(value), 4) as total, max(value) as most from events group by all")
def _(t: Tables) -> DataFrame:
    out = W.per_window(_events(t), "event_type", "ts", "value", "1 hour")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "events", F.round("total", 4).alias("total"), "most")


@query("T02_last_event_applied", "select user_id, event_type as state, event_id from (select * from events qualify row_number() over (partition by user_id order by event_id desc) = 1) where event_type <> 'error'")
def _(t: Tables) -> DataFrame:
    e = t.events.select("user_id", F.col("event_type").alias("state"), "event_id", F.when(ok(), "change").otherwise("unlink").alias("action"))
    none = e.where("false").select("user_id", "state", "event_id")
    return W.apply_changes(none, e, "user_id", "event_id")


@query("T10_streamed_changes", "select user_id, event_type as state, event_id from (select * from events qualify row_number() over (partition by user_id order by event_id desc) = 1) where event_type <> 'error'")
def _(t: Tables) -> DataFrame:
    e = t.events.schema
    stream = t.spark.readStream.schema(e).parquet(f"{t.base}/event[s].parquet")
    rows = stream.select("user_id", F.col("event_type").alias("state"), "event_id", F.when(ok(), "change").otherwise("unlink").alias("action"))
    root = shared_folder(t.spark, "watch")
    W.watch(t.spark, rows, f"{root}/table", f"{root}/checkpoint", "user_id", "event_id").awaitTermination()
    return W.watched(t.spark, f"{root}/table", rows.drop("action").schema).read().select("user_id", "state", "event_id")


@query(
    "T13_adaptive_batch",
    """with recursive e as (select event_type as key, value, row_number() over (partition by event_type order by event_id) as n from events where value is not null and event_type is not null),
s(key, n, size, quick) as (select key, 0::bigint, 50, 0 from (select distinct key from e) union all
  select s.key, e.n, case when value > 35.0::double * (1 + 0.1::double) then greatest(10, floor(size * 0.8::double)::int) when value < 35.0::double * (1 - 0.1::double) and quick >= 1 then least(200, floor(size * 1.2::double)::int) else size end,
    case when value < 35.0::double * (1 - 0.1::double) and not value > 35.0::double * (1 + 0.1::double) and quick < 1 then quick + 1 else 0 end from s join e on e.key = s.key and e.n = s.n + 1)
select key, n::int as answers, size from s qualify row_number() over (partition by key order by n desc) = 1""",
)
def _(t: Tables) -> DataFrame:
    return W.adaptive_sizes(t.events, "event_type", "event_id", "value", target=35.0)


@query("R01_semantic_query", "select e.entry_id, v.vec_id from index_entries e join embedded_chunks v on v.chunk_id = e.entry_id where v.vec_id in (select vec_id from (select vec_id, row_number() over (order by vec_id) as n from (select distinct vec_id from embedded_chunks where len(embedding) = 64)) where n <= 8)")
def _(t: Tables) -> DataFrame:
    best = R.top_k(t.embedded_chunks.where("size(embedding) = 64").select("vec_id").distinct().withColumn("score", -F.col("vec_id")), "score", 8, "vec_id").select("vec_id")
    hits = t.embedded_chunks.join(F.broadcast(best), "vec_id").select("vec_id", F.col("chunk_id").alias("entry_id"))  # eight rows
    return t.index_entries.select("entry_id").join(hits, "entry_id")
