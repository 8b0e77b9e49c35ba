"""Further projections, aggregates, set operations, plug-ins and composite jobs: queries and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
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
from quarryline.operators import scripts as J
from quarryline.operators import summary as P
from quarryline.operators import symbols as Y
from quarryline.plans import pipelines
from quarryline.plans.reference_scan import _LANG, _LOC, COMPLEXITY, ENDING, LINE_CHUNKS, _map
from quarryline.plans.reference_stats import _TECH_ENDS, _TECH_RULES
from quarryline.plans.registry import Registry, Tables
from quarryline.sources.store import Store
from quarryline.sources.tables import shared_folder

query = Registry()
#: Endings whose language the store infers when none is given.
STORED_ENDINGS = ".js .ts .py .java .cpp .c .cs .php .rb .go .rs .swift .kt .scala .html .css .json .xml .yaml .yml .md .sql".split()
#: Display names of technologies; others begin with a capital.
TECHNOLOGY_NAMES = {
    "javascript": "JavaScript", "typescript": "TypeScript", "react": "React", "vue": "Vue.js", "angular": "Angular", "python": "Python", "java": "Java", "csharp": "C#", "cpp": "C++", "php": "PHP", "html": "HTML", "css": "CSS", "sass": "Sass/SCSS", "less": "LESS", "sql": "SQL", "powershell": "PowerShell",
    "aws": "Amazon Web Services", "gcp": "Google Cloud Platform", "azure": "Microsoft Azure", "ibm-ace": "IBM App Connect Enterprise", "msgflow": "IBM Message Flow", "esql": "IBM ESQL", "dataweave": "Mulesoft DataWeave", "yaml": "YAML", "cloudformation": "AWS CloudFormation",
}

def ok() -> Column:
    return F.col("event_type") != "error"


# ------------------------------------------------------------------ scalar functions


@query("F06_cosine_unguarded", "select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as score from embeddings a join embeddings b on b.vec_id = a.vec_id + 7")
def _(t: Tables) -> DataFrame:
    other = t.embeddings.select((F.col("vec_id") - 7).alias("vec_id"), F.col("embedding").alias("b"))
    both = F.try_divide(V.dot(F.col("embedding"), F.col("b")), V.norm(F.col("embedding")) * V.norm(F.col("b")))
    return t.embeddings.join(other, "vec_id").select("vec_id", F.round(both, 6).alias("score"))


_STORED = {k: v for k, v in X.LANGUAGE_OF_ENDING.items() if k in STORED_ENDINGS}


@query("F10_stored_language", f"select entry_id, coalesce(nullif(code_language, ''), {_map(_STORED, ENDING.format('rel_path'), "'unknown'")}) as language from index_entries")
def _(t: Tables) -> DataFrame:
    inferred = X.mapped(_STORED, X.ending(F.col("rel_path")), "unknown")
    return t.index_entries.select("entry_id", F.coalesce(F.nullif("code_language", F.lit("")), inferred).alias("language"))


@query(
    "F25_insights",
    COMPLEXITY
    + """select chunk_id, unnest(list_filter([case when depth > 4 then 'Deep nesting detected - consider extracting methods' end, case when cyclomatic > 15 then 'High cyclomatic complexity - consider breaking down complex functions' end,
  case when functions > 50 then 'Large number of functions - consider organizing into modules' end], lambda x: x is not null)) as insight from s""",
)
def _(t: Tables) -> DataFrame:
    c, lang = F.col("content"), X.display_language(F.col("relative_path"))
    m = t.chunks.where("content is not null").select("chunk_id", X.cyclomatic(c, lang).alias("cyclo"), X.nesting_depth(c).alias("depth"), X.function_count(c, lang).alias("functions"))
    told = F.filter(
        F.array(
            F.when(F.col("depth") > 4, "Deep nesting detected - consider extracting methods"),
            F.when(F.col("cyclo") > 15, "High cyclomatic complexity - consider breaking down complex functions"),
            F.when(F.col("functions") > 50, "Large number of functions - consider organizing into modules"),
        ),
        lambda x: x.isNotNull(),
    )
    return m.select("chunk_id", F.explode(told).alias("insight"))


@query("F26_python_definitions", r"select chunk_id, unnest(list_distinct(regexp_extract_all(content, 'def\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1))) as name from chunks where content is not null and ends_with(relative_path, '.py')")
def _(t: Tables) -> DataFrame:
    rows = t.chunks.where(F.col("content").isNotNull() & F.col("relative_path").endswith(".py"))
    return rows.select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"def\s+([a-zA-Z_][a-zA-Z0-9_]*)"), 1))).alias("name"))


@query("F26_exports", r"select chunk_id, unnest(regexp_extract_all(content, '(?m)^[ \t]*export\s+(?:class|function|const|let|var)\s+([^\s(]+)', 1)) as name from chunks where content is not null and regexp_matches(relative_path, '\.(js|ts)$')")
def _(t: Tables) -> DataFrame:
    rows = t.chunks.where(F.col("content").isNotNull() & F.col("relative_path").rlike(r"\.(js|ts)$"))
    return rows.select("chunk_id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^[ \t]*export\s+(?:class|function|const|let|var)\s+([^\s(]+)"), 1)).alias("name"))


@query("F29_score_text", "select query_id, hit_no, round(try_cast(case when isfinite(score) then score end as decimal(20, 10)), 4)::varchar as shown from search_results")
def _(t: Tables) -> DataFrame:
    return t.search_results.select("query_id", "hit_no", X.fixed(F.col("score"), 4).alias("shown"))


@query("F30_technology_names", "select distinct coalesce((MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in TECHNOLOGY_NAMES.items()) + "})[primary_language], upper(primary_language[1]) || primary_language[2:]) as name from repositories")
def _(t: Tables) -> DataFrame:
    n = F.col("primary_language")
    return t.repositories.select(F.coalesce(X.mapped(TECHNOLOGY_NAMES, n), F.concat(F.upper(F.substring(n, 1, 1)), F.substring(n, 2, 200))).alias("name")).distinct()


#: Manifests as projects have them; the tables hold none.
MANIFESTS = [
    ("web", "package.json", '{"name": "x", "scripts": {"build": "vite build", "test": "jest --ci"}, "dependencies": {"react": "^18.2.0", "react-dom": "^18.2.0", "left-pad": "1.3.0"}, "devDependencies": {"vite": "5.0.0"}, "peerDependencies": {"next": ">=13"}}'),
    ("web", "app/package.json", "{not json"),
    ("api", "requirements.txt", "# pinned\nDjango==4.2\nrequests>=2.0 # http\nnumpy~=1.26\n-r more.txt\n\nflask"),
    ("svc", "Cargo.toml", '[package]\nname = "svc"\n\n[dependencies]\nactix-web = "4"\nserde = { version = "1.0", features = ["derive"] }\n\n[dev-dependencies]\nrocket = "0.5"\n'),
    ("jvm", "pom.xml", "<project><dependencies><dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter</artifactId><version>3.1.0</version></dependency><dependency><groupId>org.hibernate</groupId><artifactId>hibernate-core</artifactId></dependency></dependencies></project>"),
    ("jvm", "notes.txt", "react"),
]


def _manifests(t: Tables) -> DataFrame:
    """The manifests above and those among the chunks (a file's text in one chunk)."""
    own = t.spark.createDataFrame(MANIFESTS, "repo string, path string, content string")
    return own.unionByName(t.chunks.where(F.col("relative_path").rlike(r"(package\.json|requirements\.txt|Cargo\.toml|pom\.xml)$")).select(F.col("repo_id").cast("string").alias("repo"), F.col("relative_path").alias("path"), "content"))


@query(
    "F35_dependencies",
    """select * from (values ('web', 'package.json', 'dependencies', 'react', '^18.2.0'), ('web', 'package.json', 'dependencies', 'react-dom', '^18.2.0'), ('web', 'package.json', 'dependencies', 'left-pad', '1.3.0'), ('web', 'package.json', 'devDependencies', 'vite', '5.0.0'), ('web', 'package.json', 'peerDependencies', 'next', '>=13'),
('api', 'requirements.txt', 'dependencies', 'django', '4.2'), ('api', 'requirements.txt', 'dependencies', 'requests', '2.0'), ('api', 'requirements.txt', 'dependencies', 'numpy', '1.26'), ('api', 'requirements.txt', 'dependencies', 'flask', null), ('svc', 'Cargo.toml', 'dependencies', 'actix-web', '4'), ('svc', 'Cargo.toml', 'dependencies', 'serde', '1.0'),
('jvm', 'pom.xml', 'dependencies', 'org.springframework.boot:spring-boot-starter', '3.1.0'), ('jvm', 'pom.xml', 'dependencies', 'org.hibernate:hibernate-core', null)) v(repo, manifest, scope, name, version)""",
)
def _(t: Tables) -> DataFrame:
    return P.dependencies(_manifests(t), "repo", "path", "content").select("repo", "manifest", "scope", "name", "version")


@query(
    "F36_package_technologies",
    """select * from (values ('web', 'react', 0.9, 4, 'dependency'), ('web', 'next.js', 0.9, 1, 'dependency'), ('web', 'vite', 0.8, 1, 'script'), ('web', 'jest', 0.8, 1, 'script'), ('api', 'django', 0.9, 1, 'dependency'), ('api', 'numpy', 0.9, 1, 'dependency'), ('api', 'flask', 0.9, 1, 'dependency'),
('svc', 'actix', 0.9, 1, 'dependency'), ('jvm', 'spring-boot', 0.9, 1, 'dependency'), ('jvm', 'hibernate', 0.9, 1, 'dependency')) v(repo, technology, confidence, detections, sources)""",
)
def _(t: Tables) -> DataFrame:
    out = P.dependency_technologies(_manifests(t), "repo", "path", "content")
    return out.select("repo", "technology", F.col("confidence").cast("decimal(2,1)").alias("confidence"), F.col("detections").cast("int").alias("detections"), F.array_join("sources", ",").alias("sources"))


@query("F41_needs_reindex", "select vec_id, len(embedding) is distinct from 64 or provider is distinct from 'local-embed' as needs from embedded_chunks where vec_id is not null")
def _(t: Tables) -> DataFrame:
    e = t.embedded_chunks.where("vec_id is not null")
    dims = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return e.select("vec_id", (~dims.eqNullSafe(F.lit(64)) | ~F.col("provider").eqNullSafe(F.lit("local-embed"))).alias("needs"))


@query("F43_word_at", r"select doc_id, regexp_extract(substr(text, 1, 40), '([A-Za-z0-9_]+)$', 1) || regexp_extract(substr(text, 41), '^([A-Za-z0-9_]*)', 1) as word from documents where text is not null")
def _(t: Tables) -> DataFrame:
    left, right = F.regexp_extract(F.substring("text", 1, 40), r"([A-Za-z0-9_]+)\z", 1), F.regexp_extract(F.substring("text", 41, 1 << 30), r"^([A-Za-z0-9_]*)", 1)
    return t.documents.where("text is not null").select("doc_id", F.concat(left, right).alias("word"))


@query("F46_maps", "select event_id, json_extract_string(props, '$.k')::int as k from events")
def _(t: Tables) -> DataFrame:
    m = F.map_from_entries(F.map_entries(F.from_json("props", "map<string,int>")))
    return t.events.select("event_id", F.try_element_at(m, F.lit("k")).alias("k"))


# ------------------------------------------------------------------ predicates, joins, sets


@query("P03_provider_limit", "select chunk_id from chunks where ceil(length(content) / 4) <= 512")
def _(t: Tables) -> DataFrame:
    return t.chunks.where(X.tokens_estimated(F.col("content")) <= E.PROVIDERS["huggingface"][1]).select("chunk_id")


@query("P08_result_projection", "select s.query_id, s.hit_no, e.rel_path as file, e.alias as repo, c.start_line || '-' || c.end_line as lines, round(s.score, 4) as score from search_results s join (select distinct chunk_id, start_line, end_line from chunks) c using (chunk_id) join (select entry_id, min(rel_path) as rel_path, min(alias) as alias from index_entries group by 1) e on e.entry_id = s.chunk_id where s.score is not null and isfinite(s.score)")
def _(t: Tables) -> DataFrame:
    c = t.chunks.select("chunk_id", "start_line", "end_line").distinct()
    e = t.index_entries.groupBy("entry_id").agg(F.min("rel_path").alias("file"), F.min("alias").alias("repo"))
    s = t.search_results.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))).select("query_id", "hit_no", "chunk_id", "score")
    out = s.join(c, "chunk_id").join(e, F.col("entry_id") == F.col("chunk_id"))
    return out.select("query_id", "hit_no", "file", "repo", F.concat_ws("-", "start_line", "end_line").alias("lines"), F.round("score", 4).alias("score"))


@query("P14_keywords", "select term, count(*) as n from (select lower(unnest(regexp_extract_all(content, '[A-Za-z_]+'))) as term from chunks where ends_with(relative_path, '.py')) where term not in (" + ", ".join(f"'{w}'" for w in R.KEYWORDS["python"].split()) + ") group by 1")
def _(t: Tables) -> DataFrame:
    rows = t.chunks.where(F.col("relative_path").endswith(".py")).select(F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z_]+"), 0)).alias("w"))
    return rows.select(F.lower("w").alias("term")).where(~F.col("term").isin(*R.KEYWORDS["python"].split())).groupBy("term").agg(F.count("*").alias("n"))


@query("P16_confident", "with g as (select repo_id, primary_language, count(*) * 0.01 as confidence from files join repositories using (repo_id) group by all) select repo_id, primary_language from g where confidence > 0.05")
def _(t: Tables) -> DataFrame:
    g = t.files.join(t.repositories.select("repo_id", "primary_language"), "repo_id").groupBy("repo_id", "primary_language").agg((F.count("*") * 0.01).alias("confidence"))
    return g.where("confidence > 0.05").select("repo_id", "primary_language")


@query("J02_query_scores", "with q as (select embedding as e from embeddings where vec_id = (select min(vec_id) from embeddings)) select vec_id, round(list_cosine_similarity(embedding::double[], e::double[]), 6) as score from embeddings, q")
def _(t: Tables) -> DataFrame:
    first = t.embeddings.groupBy().agg(F.min_by("embedding", "vec_id").alias("e"))  # one row
    return t.embeddings.crossJoin(F.broadcast(first)).select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("e")), 6).alias("score"))


@query("J06_hash_changes", "with o as (select distinct file_id, hash from files where file_id % 3 <> 0), n as (select file_id, arg_max(hash, (last_modified, hash)) as hash from files where file_id % 4 <> 0 group by 1), l as (select file_id, arg_max(hash, hash) as hash from o group by 1) select coalesce(l.file_id, n.file_id) as file_id, case when l.file_id is null then 'added' when n.file_id is null then 'deleted' when l.hash = n.hash then 'unchanged' else 'modified' end as change from l full join n on l.file_id = n.file_id")
def _(t: Tables) -> DataFrame:
    old = t.files.where("file_id % 3 <> 0").groupBy("file_id").agg(F.max("hash").alias("hash"))
    new = t.files.where("file_id % 4 <> 0").groupBy("file_id").agg(F.max_by("hash", F.struct("last_modified", "hash")).alias("hash"))
    return C.changes(old, new, "file_id")


_RULES = [("react", r"import.*react"), ("unittest", r"import unittest"), ("logging", r"log\.info\("), ("regex", r"import re\b")]


@query("J14_rule_join", "select rule, count(*) as n from chunks join (values " + ", ".join(f"('{a}', '{b}')" for a, b in _RULES) + ") r(rule, pattern) on regexp_matches(content, pattern) group by 1")
def _(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame(_RULES, "rule string, pattern string")  # a fixed list
    return t.chunks.select("content").join(F.broadcast(rules), F.expr("content rlike pattern")).groupBy("rule").agg(F.count("*").alias("n"))


@query("U01_bag_union", "select chunk_id, 'chunk' as kind from chunks union all select entry_id, 'entry' from index_entries union all select chunk_id, 'vector' from embedded_chunks")
def _(t: Tables) -> DataFrame:
    part = lambda df, column, kind: df.select(F.col(column).alias("chunk_id"), F.lit(kind).alias("kind"))
    return part(t.chunks, "chunk_id", "chunk").unionByName(part(t.index_entries, "entry_id", "entry")).unionByName(part(t.embedded_chunks, "chunk_id", "vector"))


@query("U04_intersection", "select distinct lang from documents where doc_kind = 'readme' and lang is not null intersect select distinct lang from documents where doc_kind = 'issue'")
def _(t: Tables) -> DataFrame:
    d = t.documents.where("lang is not null")
    return d.where("doc_kind = 'readme'").select("lang").intersect(d.where("doc_kind = 'issue'").select("lang"))


@query("O05_sorted_technologies", "select repo_id, array_to_string(list_sort(list(distinct extension)), ',') as endings from files where extension is not null group by 1")
def _(t: Tables) -> DataFrame:
    return t.files.where("extension is not null").groupBy("repo_id").agg(F.array_join(F.array_sort(F.collect_set("extension")), ",").alias("endings"))


@query("O10_prefixes", "select repo_id, array_to_string(list_sort(list(distinct extension))[1:3], ',') as first from files where extension is not null group by 1")
def _(t: Tables) -> DataFrame:
    return t.files.where("extension is not null").groupBy("repo_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("extension")), 1, 3), ",").alias("first"))


# ------------------------------------------------------------------ aggregates and windows


@query("A31_optimal_batch", "with b as (select json_extract_string(props, '$.k')::int % 10 as k, avg(value) as v, count(*) filter (event_type <> 'error') / count(*) as s from events group by 1) select arg_max(k, (v, -k)) as k from b where s > 0.5")
def _(t: Tables) -> DataFrame:
    k = (F.get_json_object("props", "$.k").cast("int") % 10).alias("k")
    b = t.events.groupBy(k).agg(F.avg("value").alias("v"), (F.count_if(ok()) / F.count("*")).alias("s")).where("s > 0.5")
    return b.agg(F.max_by("k", F.struct("v", -F.col("k"))).alias("k"))


@query("A34_separation", "with p as (select a.label = b.label as same, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as c from embeddings a join embeddings b on b.vec_id > a.vec_id) select round(avg(c) filter (same) - avg(c) filter (not same), 6) as separation from p")
def _(t: Tables) -> DataFrame:
    return M.separation(t.embeddings, "label", "embedding").select(F.round("separation", 6).alias("separation"))


@query("A41_client_health", "with a as (select user_id, count(*) as n, count(*) filter (event_type <> 'error') as good, count(*) filter (event_type = 'signup') as f from events group by 1) select user_id, round(100.0 * good / n, 6) as uptime, round(greatest(0, least(100, 100.0 * good / n - 10.0 * f / n)), 6) as health from a")
def _(t: Tables) -> DataFrame:
    n, good, f = F.count("*"), F.count_if(ok()), F.count_if(F.col("event_type") == "signup")
    up = M.rate(good, n)
    return t.events.groupBy("user_id").agg(F.round(up, 6).alias("uptime"), F.round(X.clamped(up - f * 10.0 / n, 0.0, 100.0), 6).alias("health"))


@query("A43_history_means", "select user_id, round(avg(value), 6) as value, round(avg(json_extract_string(props, '$.k')::int), 6) as k from (select * from events qualify row_number() over (partition by user_id order by event_id desc) <= 20) group by 1")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    last = t.events.withColumn("_n", F.row_number().over(w)).where("_n <= 20")
    return last.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("value"), F.round(F.avg(F.get_json_object("props", "$.k").cast("int")), 6).alias("k"))


@query("A45_throughput", "select event_type, round(count(*) / (epoch(max(ts)) - epoch(min(ts))), 9) as per_second from events group by 1")
def _(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return t.events.groupBy("event_type").agg(F.round(F.count("*") / (F.max(at) - F.min(at)), 9).alias("per_second"))


def _scripts(t: Tables) -> DataFrame:
    """The structure of every version of a script file whose text is whole."""
    texts = K.whole_texts(t.chunks.where(F.col("relative_path").rlike(r"\.(js|mjs|cjs|ts)$")), "file_id", "file_hash", "relative_path")
    rows = texts.select(F.concat_ws(":", "file_id", "file_hash").alias("key"), "text", F.when(F.col("relative_path").endswith(".ts"), "typescript").otherwise("javascript").alias("language"))
    return J.script_structure(rows, "key", "text", "language")


#: The whole texts of script files, line by line, with the comments and literals that the patterns below must not see blanked.
_SCRIPT_TEXTS = r"""with l as (select distinct file_id, file_hash, start_line + i as line, string_split(content, chr(10))[i + 1] as x from (select *, unnest(range(0, len(string_split(content, chr(10))))) as i from chunks where regexp_matches(relative_path, '\.(js|mjs|cjs|ts)$') and content is not null)),
lost as (select distinct file_id, file_hash from chunks where content is null),
f as (select file_id || ':' || file_hash as key, string_agg(x, chr(10) order by line) as text from l where not exists (select 1 from lost where lost.file_id = l.file_id and lost.file_hash = l.file_hash) group by 1)
"""


@query("K11_classes", _SCRIPT_TEXTS + r"select key, unnest(regexp_extract_all(text, '(?m)^(?:public )?(?:export )?(?:default )?(?:abstract )?class (\w+)(?:<[^>{]*>)?(?: extends \w+)?[^{\n]*\{', 1)) as name from f")
def _(t: Tables) -> DataFrame:
    return _scripts(t).where("kind = 'class' and owner = 'global'").select("key", "name")


@query("K11_functions")
def _(t: Tables) -> DataFrame:
    return _scripts(t).where("kind in ('function', 'method')").select("key", "kind", "name", "type", "owner", "line", F.array_join("parameters", ",").alias("parameters"), F.array_join("flags", ",").alias("flags"))


@query("K11_variables")
def _(t: Tables) -> DataFrame:
    return _scripts(t).where("kind = 'variable'").groupBy("owner", "name", "type").agg(F.count("*").alias("n"))


@query("J12_resolved_calls")
def _(t: Tables) -> DataFrame:
    return J.resolved_calls(_scripts(t))


@query("A46_call_graph")
def _(t: Tables) -> DataFrame:
    calls = _scripts(t).where("kind = 'call' and owner <> 'global'").select("key", F.lit("call").alias("type"), F.col("owner").alias("source"), F.col("name").alias("target"))
    return L.call_graph(calls).select("key", "source", F.array_join("callees", ",").alias("callees"))


#: Fixed snippets for languages that the tables do not hold.
SNIPPETS = [
    ("esql", "CREATE FUNCTION F() RETURNS INT\nBEGIN CALL P(1); SET x = Q.R(2); END\nCREATE PROCEDURE P(IN a INT)\nBEGIN END", "esql"),
    ("dwl", "type Row = { a: String }\nvar name = 'x'\nfun up(r: Row) = upper(r.a)\nfun greet(s) = up(s)\n---\ngreet(name)", "dataweave"),
    ("mule", '<mule><flow name="main"><listener config-ref="H"/><flow-ref name="sub"/><transform/></flow><sub-flow name="sub"/></mule>', "xml"),
    ("flow", '<root><connections sourceNode="a" targetNode="b"/></root>', "xml"),
]


@query("K13_to_K17_relations", "select * from (values ('dwl', 'function-call', 'greet', 'up'), ('dwl', 'function-call', 'main', 'greet'), ('dwl', 'type-reference', 'up', 'Row'), ('dwl', 'variable-reference', 'main', 'name'), ('esql', 'call', 'F', 'P'), ('esql', 'set', 'F', 'Q.R'), ('flow', 'connection', 'a', 'b'), ('mule', 'config-reference', 'main', 'H'), ('mule', 'dataweave', 'main', 'dataweave-transformation'), ('mule', 'flow-reference', 'main', 'sub')) v(key, type, source, target)")
def _(t: Tables) -> DataFrame:
    return L.relationships(t.spark.createDataFrame(SNIPPETS, "key string, content string, language string"), "key", "content", "language")


@query("K11_inheritance", r"select chunk_id as key, unnest(regexp_extract_all(content, 'class\s+(\w+)\s+extends\s+(\w+)', 1)) as source, unnest(regexp_extract_all(content, 'class\s+(\w+)\s+extends\s+(\w+)', 2)) as target from chunks where content is not null and regexp_matches(relative_path, '\.(js|ts)$')")
def _(t: Tables) -> DataFrame:
    rows = t.chunks.where("content is not null").select("chunk_id", "content", X.language(F.col("relative_path")).alias("language"))
    return L.relationships(rows, "chunk_id", "content", "language").where("type = 'inheritance'").select("key", "source", "target")


@query("W08_rank_bonus", "select event_type, row_number() over (order by count(*) desc, event_type) as place, 10 * (5 - row_number() over (order by count(*) desc, event_type)) as bonus from events group by 1")
def _(t: Tables) -> DataFrame:
    per = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "event_type"))  # a row for each of the few types
    return per.select("event_type", place.alias("place"), (10 * (5 - place)).alias("bonus"))


@query("W12_provider_batches", "select file_id, file_hash, ordinal, floor((row_number() over (partition by file_id, file_hash order by ordinal, chunk_id) - 1) / 2)::int as batch from (select distinct file_id, file_hash, ordinal, chunk_id from chunks where content is not null)")
def _(t: Tables) -> DataFrame:
    rows = t.chunks.where("content is not null").select("file_id", "file_hash", "ordinal", "chunk_id").distinct()
    n = F.row_number().over(Window.partitionBy("file_id", "file_hash").orderBy("ordinal", "chunk_id"))
    return rows.select("file_id", "file_hash", "ordinal", F.floor((n - 1) / 2).cast("int").alias("batch"))


@query("W13_dense_numbers", "select event_id, row_number() over (order by event_id) - 1 as number from events where event_type = 'click'")
def _(t: Tables) -> DataFrame:
    return C.dense_numbers(t.events.where("event_type = 'click'").select("event_id"), "event_id")


@query("W04_adaptation", "with w as (select event_id, avg(value) over (partition by event_type order by ts, event_id rows between 2 preceding and current row) as m from events) select event_id, case when m > 40 * 1.15 then 'shrink' when m < 40 * 0.85 then 'grow' else 'keep' end as decision from w")
def _(t: Tables) -> DataFrame:
    w = M.moving_average(t.events, "event_type", ["ts", "event_id"], "value", 3, "m")
    return w.select("event_id", F.when(F.col("m") > 40 * 1.15, "shrink").when(F.col("m") < 40 * 0.85, "grow").otherwise("keep").alias("decision"))


@query("T16_throttled_progress", "select time_bucket(interval 1 minute, ts) as start, arg_max(event_id, (ts, event_id)) as last from events group by 1")
def _(t: Tables) -> DataFrame:
    at = F.window(F.col("ts").cast("timestamp"), "1 minute")["start"]
    return t.events.groupBy(at.cast("timestamp_ntz").alias("start")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("last"))


@query("Y07_change_statistics", "select change, count(*) as n from (select file_id, case when count(distinct hash) > 1 then 'modified' else 'unchanged' end as change from files group by 1) group by 1")
def _(t: Tables) -> DataFrame:
    per = t.files.groupBy("file_id").agg(F.when(F.countDistinct("hash") > 1, "modified").otherwise("unchanged").alias("change"))
    return per.groupBy("change").agg(F.count("*").alias("n"))


@query("Y09_hash_fallback", "select file_id, coalesce(hash, sha256(path || ':' || (epoch_us(last_modified) // 1000) || ':' || size)) as hash from (select file_id, case when file_id % 2 = 0 then hash end as hash, path, last_modified, size from files where size is not null)")
def _(t: Tables) -> DataFrame:
    other = F.sha2(F.concat_ws(":", "path", F.unix_millis(F.col("last_modified").cast("timestamp")).cast("string"), F.col("size").cast("string")), 256)
    return t.files.where("size is not null").select("file_id", F.coalesce(F.when(F.col("file_id") % 2 == 0, F.col("hash")), other).alias("hash"))


@query("Y13_file_analysis", f"select chunk_id, {_LOC.replace(chr(123) + '0' + chr(125), '')} as loc, len(regexp_extract_all(content, '(?m)^import ')) as imports from chunks where content is not null")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", X.code_lines(F.col("content")).alias("loc"), F.regexp_count("content", F.lit("(?m)^import ")).alias("imports"))


@query("Y14_file_complexity", COMPLEXITY + "select * from s")
def _(t: Tables) -> DataFrame:
    c, lang = F.col("content"), X.display_language(F.col("relative_path"))
    m = t.chunks.where("content is not null").select("chunk_id", X.cyclomatic(c, lang).alias("cyclomatic"), X.nesting_depth(c).alias("depth"), X.function_count(c, lang).alias("functions"), X.class_count(c).alias("classes"), X.strict_code_lines(c).alias("loc"))
    return m.withColumn("score", X.file_score(*(F.col(k) for k in ("cyclomatic", "depth", "functions", "classes", "loc"))))


@query("Y34_fallback_statistics", "select event_type, round(100.0 * count(*) filter (value < 40) / count(*), 6) as success, max(ts) + interval 1 minute as cooling_until from events group by 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(M.rate(F.count_if(F.col("value") < 40), F.count("*")), 6).alias("success"), (F.max("ts") + F.expr("interval 1 minute")).alias("cooling_until"))


# ------------------------------------------------------------------ plug-ins and composite jobs


@query("X01_embedded_texts", "select chunk_id as key, case when content is not null and length(content) <= 32768 then 'hash' end as provider, case when content is null then 'no text' when length(content) > 32768 then 'over the token limit' end as error, case when content is not null and length(content) <= 32768 then case when regexp_matches(content, '[^ \\t\\r\\n\\f\\v]') then 1.0 else 0.0 end end::double as norm from chunks")
def _(t: Tables) -> DataFrame:
    out = E.embedded(t.chunks, "chunk_id", "content", lambda: [E.HashEmbedder()])
    return out.select("key", "provider", "error", F.round(V.norm(F.col("embedding")), 4).alias("norm"))


@query("X03_cached_embeddings", "select doc_id, coalesce(length(text) <= 32768, false) as embedded from documents")
def _(t: Tables) -> DataFrame:
    empty = t.spark.createDataFrame([], "model string, text_sha string, embedding array<float>")
    rows, _ = E.with_cache(t.documents.select("doc_id", "text"), "doc_id", "text", empty, lambda: [E.HashEmbedder()], "hash")
    return rows.select("doc_id", F.col("embedding").isNotNull().alias("embedded"))


@query(
    "M01_chunked_files",
    LINE_CHUNKS
    + """, n as (select *, row_number() over (partition by doc_id order by first) - 1 as ordinal from c),
t as (select n.*, source || '/' || doc_id || '.md' as rel_path, sha256(text) as h, regexp_replace(array_to_string(l[first:last], chr(10)), '^\\s+|\\s+$', '', 'g') as chunk from n join d using (doc_id) join documents using (doc_id))
select sha256(concat_ws('∣', 'all', rel_path, ordinal::varchar, h)) as chunk_id, rel_path, ordinal::int as ordinal, first as start_line, last as end_line, size,
  case when contains(chunk, '//') or contains(chunk, '#') or contains(chunk, '--') or regexp_matches(chunk, '/\\*[\\s\\S]*?\\*/') then 'comment' else 'code' end as kind from t where length(chunk) > 0 and ceil(length(chunk) / 4) <= 2048""",
)
def _(t: Tables) -> DataFrame:
    files = t.documents.where("text is not null").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("rel_path"), F.sha2("text", 256).alias("hash"), F.lit("markdown").alias("language"), F.col("text").alias("content"))
    return pipelines.chunked(files, "all", 4000).select("chunk_id", "rel_path", "ordinal", "start_line", "end_line", "size", "kind")


_SUMMARY = f"""with r as (select repo_id, relative_path, {_LANG} as language, {_LOC.replace(chr(123) + '0' + chr(125), '')} as loc, lower(regexp_extract(relative_path, '(\\.[^./]*)$', 1)) as ending from chunks where content is not null),
per as (select repo_id, language, sum(loc) as loc from r group by all),
prim as (select repo_id, coalesce(max(language) filter (n = 1 and loc > 0), 'Unknown') as language from (select *, row_number() over (partition by repo_id order by loc desc, language) as n from per) group by 1),
tot as (select repo_id, count(*) as files, sum(loc) as loc, bool_or(contains(relative_path, 'test') or contains(relative_path, 'spec')) as tests, bool_or(contains(lower(relative_path), 'readme') or contains(relative_path, 'doc')) as docs from r group by 1),
rules(technology, part) as (values {_TECH_RULES}), ends(technology, ending) as (values {_TECH_ENDS}),
tech as (select repo_id, list_sort(list(distinct technology)) as t from (select repo_id, technology from r join rules on contains(lower(relative_path), part) union all select repo_id, technology from r join ends using (ending)) group by 1)
select repo_id, concat_ws(' ', 'This is a ' || language || ' project with ' || files || ' files and approximately ' || loc || ' lines of code.',
  case when len(t) > 3 then 'The project uses ' || array_to_string(t[1:3], ', ') || ' and ' || (len(t) - 3) || ' other technologies.' when len(t) > 0 then 'The project uses ' || array_to_string(t, ', ') || '.' end,
  case when tests then 'The project includes test files.' end, case when docs then 'Documentation is present.' end) as overview from prim join tot using (repo_id) left join tech using (repo_id)"""

query("F33_overview", _SUMMARY)(lambda t: pipelines.summarise(t.chunks.where("content is not null"), "repo_id", "relative_path", "content"))


@query("M06_project_summary", _SUMMARY)
def _(t: Tables) -> DataFrame:
    # what is stored is out of date for the repositories that have changed since; only these are summarised again
    files = t.chunks.where("content is not null").select("repo_id", "relative_path", "content")
    changed = t.files.where(F.col("last_modified") > F.lit("2025-07-15").cast("timestamp_ntz")).select("repo_id").distinct()
    full = pipelines.summarise(files, "repo_id", "relative_path", "content")
    stale = full.join(changed.withColumn("_old", F.lit(True)), "repo_id", "left").select("repo_id", F.when(F.col("_old"), "out of date").otherwise(F.col("overview")).alias("overview"))
    return pipelines.updated_summaries(stale, files, changed, "repo_id", "relative_path", "content")


@query("M14_snapshot_restored", "select file_id, arg_max(hash, (last_modified, hash)) as hash from files where last_modified <= timestamp '2025-07-15' group by 1")
def _(t: Tables) -> DataFrame:
    return t.files.where(F.col("last_modified") <= F.lit("2025-07-15").cast("timestamp_ntz")).groupBy("file_id").agg(F.max_by("hash", F.struct("last_modified", "hash")).alias("hash"))




# ------------------------------------------------------------------ store


def _store(t: Tables) -> Store:
    return Store(t.spark, shared_folder(t.spark, "store"))


def _vectors(t: Tables) -> DataFrame:
    v = t.embedded_chunks.where("vec_id is not null and chunk_id is not null").groupBy("chunk_id").agg(F.max("embedding").alias("embedding"), F.max("provider").alias("provider"))
    return v.select(F.lit("all").alias("repo_id"), "chunk_id", "embedding", "provider", F.lit(None).cast("string").alias("text_sha"))


_STORED_VECTORS = "with v as (select chunk_id, max(embedding) as embedding, max(provider) as provider from embedded_chunks where vec_id is not null and chunk_id is not null group by 1) "


@query("S15_vector_sink", _STORED_VECTORS + "select chunk_id, len(embedding) as dims, provider from v")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.replace("vectors", _vectors(t))
    v = store.read("vectors")
    return v.select("chunk_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"), "provider")


@query("S21_chunk_delete", _STORED_VECTORS + "select chunk_id from v where chunk_id not in (select chunk_id from chunks where repo_id <= 20)")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.replace("vectors", _vectors(t))
    store.remove("vectors", t.chunks.where("repo_id <= 20"), "chunk_id")
    return store.read("vectors").select("chunk_id")


@query("S24_append", _STORED_VECTORS + "select chunk_id, provider from v union all select chunk_id, 'second' from v where provider = 'hashvec'")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    store.append("vectors", _vectors(t))
    store.append("vectors", _vectors(t).where("provider = 'hashvec'").withColumn("provider", F.lit("second")))
    return store.read("vectors").select("chunk_id", "provider")


@query("S27_metadata_update", "select repo_id::varchar as repo_id, case when repo_id % 2 = 0 then 'new' else alias end as alias from repositories")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    none = lambda kind: F.lit(None).cast(kind)
    r = t.repositories.select(F.col("repo_id").cast("string").alias("repo_id"), "alias", F.col("repository_path").alias("path"), none("string").alias("provider"), none("int").alias("dimensions"), none("bigint").alias("files"), none("bigint").alias("chunks"), F.col("last_indexed").cast("timestamp").alias("indexed_at"))
    store.replace("repositories", r)
    store.upsert("repositories", r.where("cast(repo_id as int) % 2 = 0").withColumn("alias", F.lit("new")), "repo_id")
    return store.repositories()


@query("T03_file_upsert", "select chunk_id, case when repo_id = 7 then 'changed' else relative_path end as rel_path from (select distinct chunk_id, repo_id, relative_path from chunks)")
def _(t: Tables) -> DataFrame:
    rows = t.chunks.select("chunk_id", "repo_id", F.col("relative_path").alias("rel_path")).distinct()
    fresh = rows.where("repo_id = 7").withColumn("rel_path", F.lit("changed"))
    return C.upserted(rows, fresh, "chunk_id").select("chunk_id", "rel_path")


@query("T04_file_delete", "select distinct chunk_id from chunks where relative_path not in (select relative_path from files where file_id % 10 = 0)")
def _(t: Tables) -> DataFrame:
    return C.without(t.chunks.select("chunk_id", "relative_path"), t.files.where("file_id % 10 = 0"), "relative_path").select("chunk_id").distinct()


@query("M13_migration", "select distinct chunk_id, chunk_id not in (select entry_id from index_entries where entry_id is not null) as migrated, len(regexp_extract_all(content, '(?:@\\w+(?:\\([^)]*\\))?\\s*\\n\\s*)*def\\s+(\\w+)\\s*\\(([^)]*)\\)(?:\\s*->\\s*([^:]+))?:')) as functions from chunks where content is not null and ends_with(relative_path, '.py')")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    legacy = t.chunks.where(F.col("content").isNotNull() & F.col("relative_path").endswith(".py")).select("chunk_id", F.col("relative_path").alias("rel_path"), "file_hash", "ordinal", "start_line", "end_line", "size", "content").dropDuplicates(["chunk_id"])
    known = t.index_entries.select(F.col("entry_id").alias("chunk_id"))
    rows = legacy.withColumns({"repo_id": F.lit("all"), "language": X.language(F.col("rel_path"))})
    columns = store.read("chunks").columns
    store.replace("chunks", pipelines.with_structure(C.only(rows, known, "chunk_id")).select(*columns))
    before = store.read("chunks").select("chunk_id", F.lit(False).alias("_old"))
    pipelines.migrate(store, legacy, "all")
    return store.read("chunks").join(before, "chunk_id", "left").select("chunk_id", F.coalesce("_old", F.lit(True)).alias("migrated"), F.size("functions").alias("functions"))


@query("S17_basic_sink", "select repo_id::varchar as repo_id, chunk_id, max(size) as size, max(sha256(content)) as digest from chunks where content is not null and repo_id is not null group by all")
def _(t: Tables) -> DataFrame:
    store, nothing = _store(t), F.array().cast("array<struct<type:string,name:string>>")
    rows = t.chunks.where("content is not null and repo_id is not null").groupBy(F.col("repo_id").cast("string").alias("repo_id"), "chunk_id").agg(
        *[F.max(c).alias(n) for c, n in (("relative_path", "rel_path"), ("file_hash", "file_hash"), ("ordinal", "ordinal"), ("start_line", "start_line"), ("end_line", "end_line"), ("size", "size"), ("content", "content"))]
    )
    store.replace("chunks", rows.withColumns({"language": F.lit(None).cast("string"), "kind": F.lit("code"), **{k: nothing for k in N.KINDS}}))
    return store.read("chunks").select("repo_id", "chunk_id", "size", F.sha2("content", 256).alias("digest"))


@query("S28_metadata_manager", "select repo_id::varchar as repo_id, case when repo_id = 5 then 'five' else alias end as alias, len(list_filter([alias, repository_path], lambda x: x is not null)) as known from repositories where repo_id <> 9 union all select '1000', 'fresh', 1")
def _(t: Tables) -> DataFrame:
    store, none = _store(t), lambda kind: F.lit(None).cast(kind)
    rest = {"provider": none("string"), "dimensions": none("int"), "files": none("bigint"), "chunks": none("bigint"), "indexed_at": none("timestamp")}
    rows = t.repositories.select(F.col("repo_id").cast("string").alias("repo_id"), "alias", F.col("repository_path").alias("path")).withColumns(rest)
    store.replace("repositories", rows)
    store.replace_repositories("repositories", rows.where("repo_id = '5'").withColumn("alias", F.lit("five")), ["5"])
    store.append("repositories", rows.where("repo_id = '1'").withColumns({"repo_id": F.lit("1000"), "alias": F.lit("fresh"), "path": none("string")}))
    store.drop_repository("9")
    store.vacuum(keep=1)
    return store.read("repositories").select("repo_id", "alias", (F.col("alias").isNotNull().cast("int") + F.col("path").isNotNull().cast("int")).alias("known"))


@query("X04_analyzer_plugin", r"select chunk_id, regexp_extract_all(content, '(?m)^([A-Za-z][A-Za-z0-9_.]*)[ \t]*=', 1) as keys from chunks where content is not null and ends_with(relative_path, '.properties')")
def _(t: Tables) -> DataFrame:
    # an analyzer of another language is a further entry of the patterns
    plugin = {**N.PATTERNS, "properties": {"functions": [("key", r"(?m)^([A-Za-z][A-Za-z0-9_.]*)[ \t]*=", 1)]}}
    rows = t.chunks.where(F.col("content").isNotNull() & F.col("relative_path").endswith(".properties"))
    return rows.select("chunk_id", F.transform(N.symbols(F.col("content"), "properties", "functions", plugin), lambda x: x["name"]).alias("keys"))


@query("Y51_provider_switch", "select repo_id::varchar as repo_id, repo_id % 3 <> 0 or repo_id % 2 <> 0 as needs_reindex from repositories")
def _(t: Tables) -> DataFrame:
    store, none = _store(t), lambda kind: F.lit(None).cast(kind)
    i = F.col("repo_id")
    rows = t.repositories.select(i.cast("string").alias("repo_id"), "alias", F.col("repository_path").alias("path"), F.when(i % 3 == 0, "hash").when(i % 3 == 1, "other").alias("provider"), F.when(i % 2 == 0, 64).otherwise(768).alias("dimensions"), none("bigint").alias("files"), none("bigint").alias("chunks"), none("timestamp").alias("indexed_at"))
    store.replace("repositories", rows)
    return store.mark_for_reindex("hash", 64)


@query("Y17_repository_lifecycle", "select * from (values ('after replace', true, 2), ('after drop', true, 1), ('never written', false, 0)) v(step, present, repositories)")
def _(t: Tables) -> DataFrame:
    store = _store(t)
    rows = _vectors(t).where("chunk_id is not null").limit(2)
    both = rows.withColumn("repo_id", F.lit("a")).unionByName(rows.withColumn("repo_id", F.lit("b")))
    count = lambda: store.read("vectors").select("repo_id").distinct().count()
    never = ("never written", store.exists("files"), store.read("files").count())
    store.replace("vectors", both)
    first = ("after replace", store.exists("vectors"), count())
    store.drop_repository("a")
    return t.spark.createDataFrame([first, ("after drop", store.exists("vectors"), count()), never], "step string, present boolean, repositories int")


@query("S42_workspace_symbols", "with e as (select distinct entry_id, rel_path, function_name, class_name from index_entries where entry_id is not null) select coalesce(nullif(function_name, ''), nullif(class_name, '')) as name, case when nullif(function_name, '') is not null then 12 else 5 end as kind, 'file:///w/' || replace(rel_path, chr(92), '/') as uri from (select * from e order by length(rel_path) desc, rel_path, entry_id limit 50) where coalesce(nullif(function_name, ''), nullif(class_name, '')) is not null")
def _(t: Tables) -> DataFrame:
    e = t.index_entries.where("entry_id is not null").select("entry_id", "rel_path", "function_name", "class_name").distinct()
    results = e.select(F.length("rel_path").cast("double").alias("score"), "rel_path", F.col("entry_id").alias("lines"), "function_name", "class_name")
    return Y.workspace_symbols(results, "/w").select("name", "kind", "uri")


@query("S42_definitions", "select 'file:///w/' || replace(relative_path, chr(92), '/') as uri, greatest(start_line - 1, 0) as start_line, greatest(end_line - 1, 0) as end_line, count(*) as n from chunks where relative_path is not null and start_line is not null and end_line is not null group by all")
def _(t: Tables) -> DataFrame:
    results = t.chunks.where("start_line is not null and end_line is not null").select(F.col("relative_path").alias("rel_path"), F.concat_ws("-", "start_line", "end_line").alias("lines"))
    return Y.locations(results, "/w").groupBy("uri", "start_line", "end_line").agg(F.count("*").alias("n"))
