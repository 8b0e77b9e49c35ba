"""Retrieval, ranking and code structure: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.functions import vectors as V
from quarryline.operators import analyzers as N
from quarryline.operators import retrieval as R
from quarryline.plans.registry import Registry, Tables

query = Registry()
#: A fixed query vector of 64 numbers and the query texts used below.
VECTOR = [((7 * i) % 13 - 6) / 20 for i in range(64)]
_V = "[" + ", ".join(f"{x!r}" for x in VECTOR) + "]::double[]"
WORDS = "invoice total payroll record"
NAMED = "how does schedule_league or LeagueStore handle the league import"


@query("O01_cosine_topk", f"select vec_id, round(list_cosine_similarity(embedding::double[], {_V}), 6) as score from embeddings order by list_cosine_similarity(embedding::double[], {_V}) desc, vec_id limit 8")
def _(t: Tables) -> DataFrame:
    return R.cosine_search(t.embeddings, "embedding", VECTOR, 8, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("O02_topk_per_group", f"select label, vec_id, rank from (select label, vec_id, row_number() over (partition by label order by list_cosine_similarity(embedding::double[], {_V}) desc, vec_id) as rank from embeddings) where rank <= 3")
def _(t: Tables) -> DataFrame:
    scored = t.embeddings.withColumn("score", V.cosine(F.col("embedding"), V.literal(VECTOR)))
    return R.top_k_per(scored, "label", "score", 3, "vec_id").select("label", "vec_id", "rank")


@query("O03_all_scores", f"select vec_id, round(list_dot_product(embedding::double[], {_V}), 6) as dot from embeddings")
def _(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(V.dot(F.col("embedding"), V.literal(VECTOR)), 6).alias("dot"))


@query("O04_key_components", "select relative_path, loc from (select relative_path, max(length(content) - length(replace(content, chr(10), ''))) as loc from chunks where content is not null group by 1) order by loc desc, relative_path limit 20")
def _(t: Tables) -> DataFrame:
    loc = F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit("")))
    return t.chunks.where("content is not null").groupBy("relative_path").agg(F.max(loc).alias("loc")).orderBy(F.desc("loc"), "relative_path").limit(20)


@query("O07_newest_retained", "select file_id, hash from (select file_id, hash, row_number() over (partition by file_id order by last_modified desc, hash) as n from (select distinct file_id, hash, last_modified from files)) where n <= 5")
def _(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("file_id").orderBy(F.desc("last_modified"), "hash")
    return t.files.select("file_id", "hash", "last_modified").distinct().withColumn("n", F.row_number().over(w)).where("n <= 5").select("file_id", "hash")


@query("O09_seeded_sample")
def _(t: Tables) -> DataFrame:
    return t.files.select("file_id", "relative_path").distinct().orderBy(F.xxhash64("relative_path", F.lit(17)), "file_id").limit(25)


@query("R02_dot_threshold", f"select vec_id, round(dot, 6) as dot, round(greatest(0, least(1, dot)), 6) as score from (select vec_id, list_dot_product(embedding::double[], {_V}) as dot from embeddings order by dot desc, vec_id limit 20) where greatest(0, least(1, dot)) >= 0.2")
def _(t: Tables) -> DataFrame:
    return R.dot_search(t.embeddings, "embedding", VECTOR, 20, 0.2, "vec_id").select("vec_id", F.round("dot", 6).alias("dot"), F.round("score", 6).alias("score"))


_HIT = "length({0}) > 0 and contains(lower('" + NAMED + "'), lower({0}))"


@query("R03_name_boost", f"select entry_id, function_name, class_name, round(case when coalesce({_HIT.format('class_name')}, false) then least(1, 0.9 * 1.15) when coalesce({_HIT.format('function_name')}, false) then least(1, 0.9 * 1.2) else 0.9 end, 6) as score from index_entries")
def _(t: Tables) -> DataFrame:
    return t.index_entries.select("entry_id", "function_name", "class_name", F.round(R.boosted(F.lit(0.9), F.lit(NAMED), F.col("function_name"), F.col("class_name")), 6).alias("score"))


_TERMS = r"list_transform(regexp_extract_all(text, '\b([a-zA-Z][a-zA-Z0-9]{2,})\b', 1), lambda x: lower(x))"
_BM25 = f"""with d as (select doc_id, length(text) as len, {_TERMS} as terms from documents where text is not null),
s as (select count(*)::double as n, avg(len) as avglen from d),
tf as (select doc_id, len, term, count(*) as tf from (select doc_id, len, unnest(terms) as term from d) where term in ('invoice', 'total', 'payroll', 'record') group by all),
df as (select term, count(*) as df from tf group by 1),
b as (select doc_id, sum(greatest(0, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avglen))) as score from tf join df using (term) cross join s group by 1)
"""


@query("R04_bm25", _BM25 + "select doc_id, round(score, 6) as score from b")
def _(t: Tables) -> DataFrame:
    return R.bm25(t.documents, "doc_id", "text", WORDS.split()).select("doc_id", F.round("score", 6).alias("score"))


@query("R05_bm25_normalised", _BM25 + "select doc_id, round(least(1, greatest(0, score / 10)), 6) as score from b order by score desc, doc_id limit 50")
def _(t: Tables) -> DataFrame:
    out = R.bm25(t.documents, "doc_id", "text", WORDS.split()).select("doc_id", F.round(R.normalised(F.col("score")), 6).alias("score"))
    return R.top_k(out, "score", 50, "doc_id")


@query("R06_corpus_statistics", "select count(text) as n, round(avg(length(text)), 6) as average from documents")
def _(t: Tables) -> DataFrame:
    return t.documents.agg(F.count("text").alias("n"), F.round(F.avg(F.length("text")), 6).alias("average"))


@query("R07_generic_terms", f"select term, count(*) as n from (select unnest({_TERMS}) as term from documents) group by 1")
def _(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(R.generic_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def _code(language: str, names: str, quoted: str) -> str:
    words = ", ".join(f"'{w}'" for w in R.KEYWORDS["python" if language == "py" else language].split())
    return f"""select chunk_id, term, count(*) as tf from (
  select chunk_id, unnest(list_filter(list_transform(regexp_extract_all(content, '{names}', 1), lambda x: lower(x)), lambda x: x not in ({words})) ||
    flatten(list_transform(list_filter({quoted}, lambda x: length(x) between 3 and 49), lambda x: list_filter(string_split_regex(lower(x), '[^a-zA-Z0-9]+'), lambda y: length(y) > 2)))) as term
  from (select distinct chunk_id, content from chunks where ends_with(relative_path, '.{language}') and content is not null)) group by all"""


@query("R07_java_terms", _code("java", r"\b([a-zA-Z_$][a-zA-Z_$0-9]*)", "regexp_extract_all(content, '\"([^\"]+)\"', 1)"))
def _(t: Tables) -> DataFrame:
    java = t.chunks.where(F.col("relative_path").endswith(".java") & F.col("content").isNotNull()).select("chunk_id", "content").distinct()
    return R.term_frequency(java, "chunk_id", R.code_terms(F.col("content"), "java"))


_PY_QUOTED = """list_transform(regexp_extract_all(content, '"[^"''`]+"|''[^"''`]+''|`[^"''`]+`'), lambda x: x[2:-2])"""


@query("R07_python_terms", _code("py", r"\b([a-zA-Z_][a-zA-Z_0-9]*)", _PY_QUOTED))
def _(t: Tables) -> DataFrame:
    rows = t.chunks.where(F.col("relative_path").endswith(".py") & F.col("content").isNotNull()).select("chunk_id", "content").distinct()
    return R.term_frequency(rows, "chunk_id", R.code_terms(F.col("content"), "python"))


@query("R08_weighted_names", "select term, sum(w)::bigint as weight from (select lower(function_name) as term, 2 as w from index_entries where length(function_name) > 0 union all select lower(class_name), 2 from index_entries where length(class_name) > 0) group by 1")
def _(t: Tables) -> DataFrame:
    e = t.index_entries
    rows = e.select(F.lower("function_name").alias("term")).unionByName(e.select(F.lower("class_name").alias("term"))).where("length(term) > 0")
    return rows.groupBy("term").agg((2 * F.count("*")).alias("weight"))


@query("R09_query_terms", "select query_id, list_filter(string_split_regex(lower(chunk_id || ' Find_it: ' || query_id), '[^a-zA-Z0-9_]+'), lambda x: length(x) > 1) as terms from (select query_id, min(chunk_id) as chunk_id from search_results where chunk_id is not null group by 1)")
def _(t: Tables) -> DataFrame:
    q = t.search_results.where("chunk_id is not null").groupBy("query_id").agg(F.min("chunk_id").alias("chunk_id"))
    return q.select("query_id", R.query_terms(F.concat("chunk_id", F.lit(" Find_it: "), F.col("query_id").cast("string"))).alias("terms"))


@query(
    "R10_hybrid",
    _BM25
    + f", v as (select vec_id as doc_id, list_cosine_similarity(embedding::double[], {_V}) as cosine from embeddings) select v.doc_id, round((0.7 * cosine + 0.2 * least(1, greatest(0, coalesce(score, 0) / 10))) / (0.7 + 0.2 + 0.1), 6) as score from v left join b on b.doc_id = v.doc_id",
)
def _(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), V.cosine(F.col("embedding"), V.literal(VECTOR)).alias("cosine"))
    b = R.bm25(t.documents, "doc_id", "text", WORDS.split())
    return v.join(b, "doc_id", "left").select("doc_id", F.round(R.hybrid(F.col("cosine"), R.normalised(F.coalesce("score", F.lit(0.0)))), 6).alias("score"))


@query("R12_symbols", "select entry_id, function_name as symbol, 12 as kind from index_entries where contains(lower(function_name), 'league') union all select entry_id, class_name, 5 from index_entries where contains(lower(class_name), 'league')")
def _(t: Tables) -> DataFrame:
    e = t.index_entries
    of = lambda c, k: e.where(F.lower(c).contains("league")).select("entry_id", F.col(c).alias("symbol"), F.lit(k).alias("kind"))
    return of("function_name", 12).unionByName(of("class_name", 5))


@query("P04_threshold_after_cut", "select query_id, hit_no, vec_id from (select * from (select distinct query_id, hit_no, vec_id, score from search_results where score is not null) qualify row_number() over (partition by query_id order by score desc, vec_id, hit_no) <= 3) where score >= 0.5")
def _(t: Tables) -> DataFrame:
    rows = t.search_results.where("score is not null").select("query_id", "hit_no", "vec_id", "score").distinct()
    return R.top_k_per(rows, "query_id", "score", 3, "vec_id", "hit_no").where("score >= 0.5").select("query_id", "hit_no", "vec_id")


@query("P06_query_matches", "select chunk_id, contains(lower(content), 'audit') as direct, exists(select 1 where length(content) > 400) as long from chunks where content is not null")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", F.lower("content").contains("audit").alias("direct"), (F.length("content") > 400).alias("long"))


@query("P07_partial_matches", f"select chunk_id, list_filter(string_split_regex(lower('{NAMED}'), '\\s+'), lambda w: length(w) > 2 and contains(lower(content), w)) as words from chunks where content is not null")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", R.partial_matches(F.col("content"), F.lit(NAMED)).alias("words"))


@query("P09_fallback", "select c.chunk_id, coalesce(c.content, '') as context, coalesce(nullif(e.code_language, ''), 'unknown') as language, coalesce(nullif(e.chunk_type, ''), 'code') as type from chunks c left join (select entry_id, min(code_language) as code_language, min(chunk_type) as chunk_type from index_entries group by 1) e on e.entry_id = c.chunk_id")
def _(t: Tables) -> DataFrame:
    e = t.index_entries.groupBy("entry_id").agg(F.min("code_language").alias("code_language"), F.min("chunk_type").alias("chunk_type"))
    out = t.chunks.select("chunk_id", "content").join(e, F.col("entry_id") == F.col("chunk_id"), "left")
    return out.select("chunk_id", F.coalesce("content", F.lit("")).alias("context"), F.coalesce(F.nullif("code_language", F.lit("")), F.lit("unknown")).alias("language"), F.coalesce(F.nullif("chunk_type", F.lit("")), F.lit("code")).alias("type"))


@query("P10_syntax_info", r"select chunk_id, end_line - start_line + 1 as lines, len(regexp_extract_all(content, 'export\s+')) as exports, contains(content, 'async ') as async, len(regexp_extract_all(content, '@\w+')) as decorators from chunks where content is not null")
def _(t: Tables) -> DataFrame:
    c = F.col("content")
    return t.chunks.where("content is not null").select(
        "chunk_id", (F.col("end_line") - F.col("start_line") + 1).alias("lines"), F.regexp_count(c, F.lit(r"export\s+")).alias("exports"), c.contains("async ").alias("async"), F.regexp_count(c, F.lit(r"@\w+")).alias("decorators")
    )


_EXPLAIN = f"""with e as (select entry_id, min(function_name) as f, min(class_name) as k, min(code_language) as l, min(chunk_type) as y from index_entries group by 1),
x as (select c.*, f, k, l, y from (select distinct chunk_id, content, start_line, end_line from chunks where content is not null) c join e on e.entry_id = c.chunk_id),
r as (select *, list_filter([case when {_HIT.format('f')} then 'function ''' || f || '''' end, case when {_HIT.format('k')} then 'class ''' || k || '''' end, case when contains(lower(content), lower('{NAMED}')) then 'direct content match' end], lambda z: z is not null) as reasons from x)
select chunk_id, '73% match' || case when len(reasons) > 0 then ' - found in ' || array_to_string(reasons, ', ') when y = 'function' then ' - semantic match in function' when y = 'class' then ' - semantic match in class definition' when y = 'import' then ' - related imports'
  when y = 'comment' then ' - documentation/comments' else ' - semantic similarity' end || ' (' || coalesce(l, 'unknown') || ', lines ' || start_line || '-' || end_line || ')' as why from r"""


@query("F27_explanation", _EXPLAIN)
def _(t: Tables) -> DataFrame:
    e = t.index_entries.groupBy("entry_id").agg(F.min("function_name").alias("f"), F.min("class_name").alias("k"), F.min("code_language").alias("l"), F.min("chunk_type").alias("y"))
    c = t.chunks.where("content is not null").select("chunk_id", "content", "start_line", "end_line").distinct()
    why = R.explanation(F.lit(0.73), F.lit(NAMED), F.col("content"), F.col("y"), F.col("f"), F.col("k"), F.col("l"), F.col("start_line"), F.col("end_line"))
    return c.join(e, F.col("entry_id") == F.col("chunk_id")).select("chunk_id", why.alias("why"))


@query("F28_confidence", "select query_id, hit_no, case when score > 0.8 then 'High' when score > 0.6 then 'Medium' else 'Low' end as label from search_results")
def _(t: Tables) -> DataFrame:
    return t.search_results.select("query_id", "hit_no", R.confidence(F.col("score")).alias("label"))


@query("F07_score_clamp", "select query_id, hit_no, round(greatest(0, least(1, score)), 4) as score from search_results where score is not null and isfinite(score)")
def _(t: Tables) -> DataFrame:
    ok = t.search_results.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    return ok.select("query_id", "hit_no", F.round(X.clamped(F.col("score")), 4).alias("score"))


@query("F05_cosine_pairs", "with v as (select vec_id, max(embedding) as e from embedded_chunks where len(embedding) = 64 and list_bool_and(list_transform(embedding, lambda x: isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0)) group by 1) select a.vec_id, round(list_cosine_similarity(a.e::double[], b.e::double[]), 6) as score from v a join v b on b.vec_id = a.vec_id + 1")
def _(t: Tables) -> DataFrame:
    ok = (F.size("embedding") == 64) & F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = t.embedded_chunks.where(ok).groupBy("vec_id").agg(F.max("embedding").alias("e"))
    following = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("e2"))
    return v.join(following, "vec_id").select("vec_id", F.round(V.cosine(F.col("e"), F.col("e2")), 6).alias("score"))


@query("A47_term_frequency", f"select doc_id, term, count(*) as tf from (select doc_id, unnest({_TERMS}) as term from documents) group by all")
def _(t: Tables) -> DataFrame:
    return R.term_frequency(t.documents, "doc_id", R.generic_terms(F.col("text")))


@query("J15_document_frequency", f"select term, count(*) as df from (select distinct doc_id, unnest({_TERMS}) as term from documents) group by 1")
def _(t: Tables) -> DataFrame:
    return R.document_frequency(R.term_frequency(t.documents, "doc_id", R.generic_terms(F.col("text"))))


# ------------------------------------------------------------------ code structure


def _sql(language: str, kind: str, ends: str) -> str:
    every = " || ".join(f"list_transform(regexp_extract_all(content, '{p.replace(chr(39), chr(39) * 2).replace('.*$', '[^' + chr(92) + 'r' + chr(92) + 'n]*')}', {g}), lambda x: {{'type': '{k}', 'name': trim(x, ' ')}})" for k, p, g in N.PATTERNS[language][kind])
    where = " or ".join(f"ends_with(relative_path, '{e}')" for e in ends.split())
    skip = " where s.name not in ('if', 'for', 'while', 'switch', 'catch', 'return')" if kind == "functions" and language in ("java", "cpp", "dart") else ""
    return f"select chunk_id, s.type as type, s.name as name from (select chunk_id, unnest({every}) as s from chunks where content is not null and ({where})){skip}"


def _symbols(language: str, kind: str, ends: str):
    def run(t: Tables) -> DataFrame:
        path = F.col("relative_path")
        wanted = [path.endswith(e) for e in ends.split()]
        rows = t.chunks.where(F.col("content").isNotNull() & (wanted[0] if len(wanted) == 1 else wanted[0] | wanted[1] | (wanted[2] if len(wanted) > 2 else F.lit(False))))
        return rows.select("chunk_id", F.explode(N.symbols(F.col("content"), language, kind)).alias("s")).select("chunk_id", "s.type", "s.name")

    return run


for _name, _lang, _ends in (("K02_javascript", "javascript", ".js .mjs .cjs"), ("K02_typescript", "typescript", ".ts"), ("K03_python", "python", ".py"), ("K04_java", "java", ".java"), ("K07_yaml", "yaml", ".yml .yaml")):
    for _kind in N.PATTERNS[_lang]:
        query(f"{_name}_{_kind}", _sql(_lang, _kind, _ends))(_symbols(_lang, _kind, _ends))

#: Fixed snippets for languages that the tables do not hold.
SNIPPETS = [
    ("cpp", "#include <vector>\nclass Store : public Base {\n};\nint add(int a, int b) {\n  if (a) { return b; }\n}\n/// Adds.\n"),
    ("dart", "import 'package:app/main.dart' as app;\nclass Cart extends Base {\n  int total(int x) {\n  }\n  factory Cart.empty() {\n  }\n}\n"),
    ("esql", "BROKER SCHEMA com.example\nCREATE COMPUTE MODULE First\nCREATE FUNCTION Simple() RETURNS BOOLEAN\nCREATE PROCEDURE Copy(IN a INTEGER, OUT b INTEGER)\n-- done\n"),
    ("dataweave", "%dw 2.0\nimport upper from dw::core::Strings\ntype Row = { a: String }\nfun greet(name) = upper(name)\n// end\n---\n"),
]


@query("K05_other_languages")
def _(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame(SNIPPETS, "language string, content string")
    out = None
    for language, _ in SNIPPETS:
        for kind in N.PATTERNS[language]:
            part = rows.where(F.col("language") == language).select("language", F.lit(kind).alias("kind"), F.explode(N.symbols(F.col("content"), language, kind)).alias("s")).select("language", "kind", "s.type", "s.name")
            out = part if out is None else out.unionByName(part)
    return out


def _each_language(t: Tables, one) -> DataFrame:
    """What `one` makes of the chunks with text, language by language as their paths say; languages without patterns go as ""."""
    rows = t.chunks.where("content is not null").withColumn("_l", F.coalesce(X.language(F.col("relative_path")), F.lit("unknown")))
    known = [k for k in N.PATTERNS if k]
    out = one(rows.where(~F.col("_l").isin(known)), "")
    for k in known:
        out = out.unionByName(one(rows.where(F.col("_l") == k), k))
    return out


_ENDINGS = {"javascript": "js|jsx", "typescript": "ts|tsx", "python": "py", "java": "java", "yaml": "yml|yaml"}


def _some(language: str, kind: str) -> str:
    """How many symbols of a kind a text has."""
    each = []
    for _, pattern, group in N.PATTERNS[language].get(kind, []):
        found = f"regexp_extract_all(content, '{pattern.replace(chr(39), chr(39) * 2).replace('.*$', '[^' + chr(92) + 'r' + chr(92) + 'n]*')}', {group})"
        skip = "list_filter({0}, lambda x: trim(x) not in ('if', 'for', 'while', 'switch', 'catch', 'return'))" if kind == "functions" and language in ("java", "cpp", "dart") else "{0}"
        each.append(f"len({skip.format(found)})")
    return " + ".join(each) or "0"


def _kinds() -> str:
    """K01 over the languages of the tables, in the order of precedence."""
    kind, functions, imports = "", "", ""
    for k in ("javascript", "typescript", "python", "java", "yaml"):
        order = (("functions", "function"), ("classes", "class"), *(() if k == "yaml" else (("imports", "import"), ("comments", "comment"))))
        kind += f"when '{k}' then case " + " ".join(f"when {_some(k, a)} > 0 then '{b}'" for a, b in order) + " else 'code' end "
        functions += f"when '{k}' then {_some(k, 'functions')} "
        imports += f"when '{k}' then {_some(k, 'imports')} "
    lang = "case " + " ".join(f"when regexp_matches(lower(relative_path), '[.]({v})$') then '{k}'" for k, v in _ENDINGS.items()) + " else '' end"
    return f"select chunk_id, case l {kind}else 'code' end as kind, case l {functions}else 0 end as functions, case l {imports}else 0 end as imports from (select *, {lang} as l from chunks where content is not null)"


@query("K01_structure_kind", _kinds())
def _(t: Tables) -> DataFrame:
    return _each_language(t, lambda rows, k: N.structure(rows, "content", k or "unknown").select("chunk_id", "kind", F.size("functions").alias("functions"), F.size("imports").alias("imports")))


@query("K09_generic_comments", r"select chunk_id, len(regexp_extract_all(content, '(?m)//.*$')) + len(regexp_extract_all(content, '/\*[\s\S]*?\*/')) as c_style, len(regexp_extract_all(content, '(?m)#.*$')) as hash, len(regexp_extract_all(content, '(?m)--.*$')) as dash from chunks where content is not null")
def _(t: Tables) -> DataFrame:
    found = N.symbols(F.col("content"), "", "comments")
    n = lambda k: F.size(F.filter(found, lambda s: s["type"] == k))
    return t.chunks.where("content is not null").select("chunk_id", n("c-style").alias("c_style"), n("hash").alias("hash"), n("dash").alias("dash"))


@query("K15_parameters")
def _(t: Tables) -> DataFrame:
    rows = t.chunks.where("content is not null")
    inside = F.explode(F.regexp_extract_all("content", F.lit(r"function\s+\w+\s*\(([^)]*)\)"), 1)).alias("parameters")
    return rows.select("chunk_id", inside).select("chunk_id", "parameters", N.split_parameters(F.col("parameters")).alias("parts"))


@query("J12_call_edges")
def _(t: Tables) -> DataFrame:
    return _each_language(t, lambda rows, k: N.call_edges(rows, "chunk_id", "content", k))


FLOWS = [
    ("a.xml", '<mule xmlns="http://x"><flow name="main"><flow-ref name="sub"/><flow-ref name="gone"/></flow><sub-flow name="sub"><logger message="m"/></sub-flow></mule>'),
    ("b.xml", '<flow name="only"/>'),
    ("c.xml", "no xml"),
]


@query("K18_xml_nodes")
def _(t: Tables) -> DataFrame:
    return N.xml_nodes(t.spark.createDataFrame(FLOWS, "file string, content string"), "file", "content").select("key", "path", "tag", F.to_json("attributes").alias("attributes"))


@query("J13_flow_references")
def _(t: Tables) -> DataFrame:
    return N.flow_references(N.xml_nodes(t.spark.createDataFrame(FLOWS, "file string, content string"), "file", "content"))
