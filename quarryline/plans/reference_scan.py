"""Scans, scalar functions, predicates, chunkers and joins: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions import text as X
from quarryline.operators import changes as C
from quarryline.operators import chunkers as K
from quarryline.operators import embedding as E
from quarryline.plans.registry import Registry, Tables
from quarryline.sources import files as S
from quarryline.sources.store import Store
from quarryline.sources.tables import shared_folder

query = Registry()
ENDING = r"lower(regexp_extract({0}, '(\.[^./]*)$', 1))"


def _map(table: dict[str, str], key: str, default: str) -> str:
    return f"coalesce((MAP {{{', '.join(f"'{k}': '{v}'" for k, v in table.items())}}})[{key}], {default})"


def _quoted(x: str) -> str:
    return x.replace("'", "''")


@query("S01_scan_tree")
def _(t: Tables) -> DataFrame:
    return S.scan_tree(t.spark, t.base).select("rel_path", "extension", "size")


@query("S04_exclusion_anchored", f"select file_id, relative_path from files where not regexp_matches(relative_path, '{_quoted(S.exclusion_regex((), False))}')")
def _(t: Tables) -> DataFrame:
    return t.files.where(~S.excluded(F.col("relative_path"), (), False)).select("file_id", "relative_path")


@query("S05_exclusion_globs", f"select file_id, relative_path from files where not regexp_matches(relative_path, '{_quoted(S.exclusion_regex(('**/*.test.js', '**/*.spec.js')))}')")
def _(t: Tables) -> DataFrame:
    return t.files.where(~S.excluded(F.col("relative_path"), ("**/*.test.js", "**/*.spec.js"))).select("file_id", "relative_path")


@query("S06_size_limit", f"select file_id, size from files where size <= {S.MAX_INDEXED}")
def _(t: Tables) -> DataFrame:
    return t.files.where(F.col("size") <= S.MAX_INDEXED).select("file_id", "size")


@query(
    "S07_text_sniff",
    """with h as (select doc_id, substr(hex(encode(text)), 1, 1024) as x from documents where text is not null)
select doc_id, length(x) = 0 or (not list_contains(regexp_extract_all(x, '(..)', 1), '00')
  and len(list_filter(regexp_extract_all(x, '(09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])|..', 1), lambda g: g <> '')) / (length(x) / 2) > 0.7) as textual from h""",
)
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.coalesce(X.looks_textual(F.col("text")), F.lit(False)).alias("textual"))


@query("S08_read_limit", f"select doc_id, length(text) as chars from documents where text is not null and octet_length(encode(text)) <= {S.MAX_READ}")
def _(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").isNotNull() & (F.octet_length("text") <= S.MAX_READ)).select("doc_id", F.length("text").alias("chars"))


@query("S09_lines", "select doc_id, unnest(range(1, len(l) + 1)) as line_no, unnest(l) as line from (select doc_id, string_split_regex(text, '\\r?\\n') as l from documents where text is not null)")
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\\r?\\n", -1)).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


@query("S10_file_probe", "select file_id, size, last_modified, size is not null and size <= 10485760 as readable from files")
def _(t: Tables) -> DataFrame:
    return t.files.select("file_id", "size", "last_modified", (F.col("size").isNotNull() & (F.col("size") <= S.MAX_READ)).alias("readable"))


@query("S11_mime", f"select file_id, {_map(X.MIME_OF_ENDING, ENDING.format('relative_path'), 'null')} as mime from files")
def _(t: Tables) -> DataFrame:
    return t.files.select("file_id", X.mime_type(F.col("relative_path")).alias("mime"))


@query("S12_sources", "select distinct primary_language as set_name, repository_path as path from repositories where repository_path not like '%forge%' and primary_language <> 'java' union select 'extra', '/srv/extra'")
def _(t: Tables) -> DataFrame:
    store = Store(t.spark, shared_folder(t.spark, "store"))
    sets = t.repositories.select(F.col("primary_language").alias("set_name"), F.col("repository_path").alias("path"))
    store.replace("sources", sets.distinct())
    store.remove_sources(sets.where(F.col("path").contains("forge")))
    store.add_source("extra", "/srv/extra")
    store.add_source("extra", "/srv/extra")
    store.drop_set("java")
    return store.read("sources")


@query("S13_repo_identity", "select repo_id, sha256(alias || '∣' || repository_path) as identity from repositories")
def _(t: Tables) -> DataFrame:
    return t.repositories.select("repo_id", F.sha2(F.concat_ws("∣", "alias", "repository_path"), 256).alias("identity"))


@query("S14_repo_short_id", "select repo_id, substr(sha256(repository_path), 1, 16) as short_id from repositories")
def _(t: Tables) -> DataFrame:
    return t.repositories.select("repo_id", F.substring(F.sha2("repository_path", 256), 1, 16).alias("short_id"))


@query("S22_manifest", "select repo_id, relative_path, file_hash, count(distinct chunk_id) as chunks, max(indexed_at) as indexed_at from chunks group by all")
def _(t: Tables) -> DataFrame:
    return t.chunks.groupBy("repo_id", "relative_path", "file_hash").agg(F.countDistinct("chunk_id").alias("chunks"), F.max("indexed_at").alias("indexed_at"))


@query(
    "S26_remove_and_renumber",
    "with v as (select vec_id, label from embeddings where vec_id not in (select distinct vec_id from embedded_chunks where vec_id % 3 = 0)) select vec_id, label, row_number() over (order by vec_id) - 1 as number from v",
)
def _(t: Tables) -> DataFrame:
    gone = t.embedded_chunks.where("vec_id % 3 = 0")
    return C.dense_numbers(C.without(t.embeddings.select("vec_id", "label"), gone, "vec_id"), "vec_id")


@query("S30_repositories_listed", "select distinct repo_id from files")
def _(t: Tables) -> DataFrame:
    return t.files.select("repo_id").distinct()


@query("S31_embedding_cache", "select sha256(text) as key, 'hash' as model, 64 as dims from documents where text is not null and length(text) <= 32768 group by text")
def _(t: Tables) -> DataFrame:
    store, texts = Store(t.spark, shared_folder(t.spark, "store")), t.documents.select("doc_id", "text")
    for _ in range(2):  # the second time all texts are found, so nothing is added
        gained = E.with_cache(texts, "doc_id", "text", store.read("embed_cache"), lambda: [E.HashEmbedder()], "hash")[1]
        store.append("embed_cache", gained)
    return store.read("embed_cache").select(F.col("text_sha").alias("key"), "model", F.size("embedding").alias("dims"))


@query("S32_encrypted_round_trip", "select doc_id, text from documents where text is not null")
def _(t: Tables) -> DataFrame:
    secret = F.unhex(F.lit("000102030405060708090a0b0c0d0e0f101112131415161718191a1b1c1d1e1f"))
    box = F.aes_encrypt(F.encode("text", "UTF-8"), secret, F.lit("GCM"))
    return t.documents.where("text is not null").select("doc_id", F.decode(F.aes_decrypt(box, secret, F.lit("GCM")), "UTF-8").alias("text"))


@query("S34_numbered_lines", "select doc_id, list_aggregate(list_transform(range(1, len(l) + 1), lambda i: format('{:4d} | {}', i, l[i])), 'string_agg', chr(10)) as shown from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)")
def _(t: Tables) -> DataFrame:
    shown = F.transform(X.lines_of(F.col("text")), lambda x, i: F.concat(F.lpad((i + 1).cast("string"), 4, " "), F.lit(" | "), x))
    return t.documents.where("text is not null").select("doc_id", F.array_join(shown, "\n").alias("shown"))


@query("S35_summary_json", "select repo_id, alias, primary_language as lang, strftime(last_indexed, '%Y-%m-%d') as day from repositories")
def _(t: Tables) -> DataFrame:
    packed = t.repositories.select("repo_id", F.to_json(F.struct("alias", F.col("primary_language").alias("lang"), F.date_format("last_indexed", "yyyy-MM-dd").alias("day"))).alias("j"))
    return packed.select("repo_id", F.from_json("j", "alias string, lang string, day string").alias("v")).select("repo_id", "v.*")


# ------------------------------------------------------------------ functions


@query("F01_sha256", "select doc_id, sha256(text) as hash from documents where text is not null")
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"))


@query("F02_short_chunk_id", "select chunk_id, 'chunk_' || substr(md5(file_path || ':' || ordinal || ':' || substr(content, 1, 100)), 1, 12) as short_id from chunks where content is not null")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", X.short_chunk_id(F.col("file_path"), F.col("ordinal"), F.col("content")).alias("short_id"))


@query("F03_chunk_id", "select chunk_id, sha256(alias || '∣' || relative_path || '∣' || ordinal || '∣' || file_hash) as id from chunks join repositories using (repo_id)")
def _(t: Tables) -> DataFrame:
    return t.chunks.join(t.repositories.select("repo_id", "alias"), "repo_id").select("chunk_id", X.chunk_id(F.col("alias"), F.col("relative_path"), F.col("ordinal"), F.col("file_hash")).alias("id"))


@query("F04_tokens", "select chunk_id, ceil(length(content) / 4)::int as tokens from chunks where content is not null")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", X.tokens_estimated(F.col("content")).alias("tokens"))


@query("F08_alias", "select doc_id, coalesce(nullif(substr(regexp_replace(source || ' ' || coalesce(lang, '?'), '[^A-Za-z0-9_-]', '-', 'g'), 1, 64), ''), 'repo') as alias from documents where source is not null")
def _(t: Tables) -> DataFrame:
    return t.documents.where("source is not null").select("doc_id", X.sanitized(F.concat("source", F.lit(" "), F.coalesce("lang", F.lit("?")))).alias("alias"))


@query("F09_language", f"select file_id, {_map(X.LANGUAGE_OF_ENDING, ENDING.format('relative_path'), "'unknown'")} as language from files")
def _(t: Tables) -> DataFrame:
    return t.files.select("file_id", X.language(F.col("relative_path")).alias("language"))


@query("F11_display_language", f"select file_id, {_map(X.DISPLAY_OF_ENDING, ENDING.format('relative_path'), "'Unknown'")} as language from files")
def _(t: Tables) -> DataFrame:
    return t.files.select("file_id", X.display_language(F.col("relative_path")).alias("language"))


_KIND = "case " + " ".join(f"when regexp_matches(trim(content, ' '), '{_quoted(p)}') then '{k}'" for k, p in X.KIND_PATTERNS.items()) + " else 'code' end"


@query("F12_code_kind", f"select chunk_id, {_KIND} as kind from chunks where content is not null")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", X.code_kind(F.col("content")).alias("kind"))


def _first(patterns: tuple[str, ...]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(content, '{_quoted(p)}', 1), '')" for p in patterns) + ")"


@query("F13_function_name", f"select chunk_id, {_first(X.FUNCTION_NAMES)} as name from chunks where content is not null")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", X.first_of(F.col("content"), X.FUNCTION_NAMES).alias("name"))


@query("F14_class_name", f"select chunk_id, {_first(X.CLASS_NAMES)} as name from chunks where content is not null")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", X.first_of(F.col("content"), X.CLASS_NAMES).alias("name"))


_IMPORTS = " || ".join(f"regexp_extract_all(content, '{_quoted(p)}', 1)" for p in X.IMPORTS)


@query("F15_imports", f"select chunk_id, unnest(range(len(m))) as n, unnest(m) as module from (select chunk_id, {_IMPORTS} as m from chunks where content is not null)")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", F.posexplode(X.imported_modules(F.col("content"))).alias("n", "module"))


@query("F16_fixed_chunks", "select doc_id, i as chunk_no, length(substr(text, 3400 * i + 1, 4000)) as size, sha256(substr(text, 3400 * i + 1, 4000)) as hash from (select doc_id, text, unnest(range(0, 1 + greatest(0, ceil((length(text) - 4000) / 3400))::int)) as i from documents where length(text) > 0)")
def _(t: Tables) -> DataFrame:
    return K.fixed_chunks(t.documents, "text").select("doc_id", "chunk_no", F.length("chunk").alias("size"), F.sha2("chunk", 256).alias("hash"))


#: Chunks of whole lines: c(doc_id, first, last, size) and d(doc_id, l), the lines of each document.
LINE_CHUNKS = """with recursive d as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null),
p as (select doc_id, l, list_transform(l, lambda x: length(x) + 1) as n from d),
s(doc_id, i, first, size, a, b, z) as (
  select doc_id, 0, 1, 0, null::int, null::int, null::int from p
  union all
  select s.doc_id, i + 1,
    case when size + n[i + 1] > 4000 and size > 0 then greatest(first, i - greatest(1, floor((i - first) * 0.15)::int) + 1) when size = 0 then i + 1 else first end,
    case when size + n[i + 1] > 4000 and size > 0 then list_sum(n[greatest(first, i - greatest(1, floor((i - first) * 0.15)::int) + 1) : i + 1])::int else size + n[i + 1] end,
    case when size + n[i + 1] > 4000 and size > 0 then first end, case when size + n[i + 1] > 4000 and size > 0 then i end, case when size + n[i + 1] > 4000 and size > 0 then size end
  from s join p using (doc_id) where i < len(n)),
c as (select doc_id, a as first, b as last, z as size from s where a is not null union all select doc_id, first, len(n), s.size from s join p using (doc_id) where i = len(n))
"""


@query(
    "F17_line_chunks",
    LINE_CHUNKS
    + """select doc_id, first as start_line, last as end_line, size from c join d using (doc_id)
where length(regexp_replace(array_to_string(l[first:last], chr(10)), '^\\s+|\\s+$', '', 'g')) > 0""",
)
def _(t: Tables) -> DataFrame:
    return K.line_chunks(t.documents, "text").select("doc_id", "start_line", "end_line", "size")


@query("F18_boundary_chunks")
def _(t: Tables) -> DataFrame:
    return K.boundary_chunks(t.documents, "doc_id", "text")


_LOC = "len(list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')), lambda x: length(x) > 0 and not starts_with(x, '//') and not starts_with(x, '#'){0}))"
_STRICT = " and not starts_with(x, '/*') and not starts_with(x, '*')"


@query("F19_code_lines", f"select chunk_id, {_LOC.replace(chr(123) + '0' + chr(125), '')} as loc from chunks where content is not null")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", X.code_lines(F.col("content")).alias("loc"))


@query("F20_strict_code_lines", f"select chunk_id, {_LOC.replace(chr(123) + '0' + chr(125), _STRICT)} as loc from chunks where content is not null")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", X.strict_code_lines(F.col("content")).alias("loc"))


_LANG = _map(X.DISPLAY_OF_ENDING, ENDING.format("relative_path"), "'Unknown'")
_CYCLO = f"1 + len(regexp_extract_all(content, case when {_LANG} = 'Python' then '\\b(?:{X.BRANCHES['Python']})\\b' else '\\b(?:{X.BRANCHES['']})\\b' end))"


@query("F21_cyclomatic", f"select chunk_id, {_CYCLO} as complexity from chunks where content is not null")
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", X.cyclomatic(F.col("content"), X.display_language(F.col("relative_path"))).alias("complexity"))


_DEPTH = "greatest(0, list_max(list_transform(range(1, len(b) + 1), lambda i: list_sum(b[1:i]))))::int"


@query(
    "F22_nesting_depth",
    f"select chunk_id, {_DEPTH} as depth from (select chunk_id, list_transform(string_split(content, chr(10)), lambda x: len(regexp_extract_all(x, '[{{(]')) - len(regexp_extract_all(x, '[}})]'))) as b from chunks where content is not null)",
)
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", X.nesting_depth(F.col("content")).alias("depth"))


@query(
    "F23_counts",
    f"select chunk_id, len(regexp_extract_all(content, case when {_LANG} = 'Python' then '\\bdef\\s+\\w+' else '\\b(?:function\\s+\\w+|const\\s+\\w+\\s*=\\s*\\(|\\w+\\s*\\(.*\\)\\s*=>)' end)) as functions, len(regexp_extract_all(content, '\\bclass\\s+\\w+')) as classes from chunks where content is not null",
)
def _(t: Tables) -> DataFrame:
    return t.chunks.where("content is not null").select("chunk_id", X.function_count(F.col("content"), X.display_language(F.col("relative_path"))).alias("functions"), X.class_count(F.col("content")).alias("classes"))


_NEST = "list_transform(string_split(content, chr(10)), lambda x: len(regexp_extract_all(x, '[{(]')) - len(regexp_extract_all(x, '[})]')))"
_FUNCS = f"len(regexp_extract_all(content, case when {_LANG} = 'Python' then '\\bdef\\s+\\w+' else '\\b(?:function\\s+\\w+|const\\s+\\w+\\s*=\\s*\\(|\\w+\\s*\\(.*\\)\\s*=>)' end))"
#: (chunk_id, cyclomatic, depth, functions, classes, loc, score) of every chunk with text.
COMPLEXITY = f"""with b as (select *, {_NEST} as b from chunks where content is not null),
m as (select chunk_id, {_CYCLO} as cyclomatic, {_DEPTH} as depth, {_FUNCS} as functions, len(regexp_extract_all(content, '\\bclass\\s+\\w+')) as classes, {_LOC.replace(chr(123) + '0' + chr(125), _STRICT)} as loc from b),
s as (select *, least(10, greatest(1, floor(least(cyclomatic / 10, 10) * 0.3::double + least(depth / 5, 10) * 0.2::double + least(functions / 20, 10) * 0.2::double + least(classes / 10, 10) * 0.1::double + least(loc / 500, 10) * 0.2::double + 0.5)))::int as score from m)
"""


@query("F24_file_score", COMPLEXITY + "select chunk_id, score from s")
def _(t: Tables) -> DataFrame:
    c, lang = F.col("content"), X.display_language(F.col("relative_path"))
    return t.chunks.where("content is not null").select("chunk_id", X.file_score(X.cyclomatic(c, lang), X.nesting_depth(c), X.function_count(c, lang), X.class_count(c), X.strict_code_lines(c)).alias("score"))


@query("F34_versions", "select doc_id, split_part(v, '.', 1)::int as major, split_part(v, '.', 2)::int as minor, split_part(v, '.', 3)::int as patch from (select doc_id, regexp_extract(text, '([0-9]{1,4}\\.[0-9]{1,4}\\.[0-9]{1,4})', 1) as v from documents) where v <> ''")
def _(t: Tables) -> DataFrame:
    v = F.regexp_extract("text", r"([0-9]{1,4}\.[0-9]{1,4}\.[0-9]{1,4})", 1)
    key = X.version_key(F.col("v"))
    return t.documents.select("doc_id", v.alias("v")).where("v <> ''").select("doc_id", key[0].alias("major"), key[1].alias("minor"), key[2].alias("patch"))


@query("F38_formatting", "select file_id, case when size < 1024 then size || 'B' when size < 1048576 then printf('%.1fKB', floor(size / 1024.0 * 10 + 0.5) / 10) else printf('%.1fMB', floor(size / 1048576.0 * 10 + 0.5) / 10) end as shown from files where size is not null and size < 1073741824")
def _(t: Tables) -> DataFrame:
    return t.files.where("size is not null and size < 1073741824").select("file_id", X.bytes_formatted(F.col("size")).alias("shown"))


@query("F39_backoff", "select event_id, least(1000.0 * pow(2, event_id % 7) * case when event_type = 'error' then 2 else 1 end, 30000.0) as wait_ms from events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.backoff_ms((F.col("event_id") % 7).cast("double"), limited=F.col("event_type") == "error").alias("wait_ms"))


_ERROR = "case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{k}'" for k, p in X.ERROR_CLASSES) + " else 'UNKNOWN_ERROR' end"


@query("F40_error_class", f"select doc_id, {_ERROR} as class, nullif(regexp_extract(lower(text), 'retry.*?(\\d+)', 1), '') as retry from documents where text is not null")
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", X.error_class(F.col("text")).alias("class"), F.nullif(F.regexp_extract(F.lower("text"), r"retry.*?(\d+)", 1), F.lit("")).alias("retry"))


@query("F44_age", "select repo_id, floor((epoch_ms(timestamp '2025-09-01') - epoch_ms(last_indexed)) / 86400000)::bigint as days, epoch_ms(last_indexed) as ms from repositories")
def _(t: Tables) -> DataFrame:
    ms = F.unix_millis(F.col("last_indexed").cast("timestamp"))
    return t.repositories.select("repo_id", F.floor((F.lit(1756684800000) - ms) / 86400000).alias("days"), ms.alias("ms"))


#: (file_id, file_hash, text) of every version of a file all of whose chunks have text.
WHOLE = """with l as (select distinct file_id, file_hash, start_line + i as line, string_split(content, chr(10))[i + 1] as x from (select *, unnest(range(0, len(string_split(content, chr(10))))) as i from chunks where content is not null)),
lost as (select distinct file_id, file_hash from chunks where content is null),
f as (select file_id, file_hash, string_agg(x, chr(10) order by line) as text from l where not exists (select 1 from lost where lost.file_id = l.file_id and lost.file_hash = l.file_hash) group by 1, 2)
"""


@query("S08_whole_texts", WHOLE + "select file_id, file_hash, sha256(text) as digest from f")
def _(t: Tables) -> DataFrame:
    return K.whole_texts(t.chunks, "file_id", "file_hash").select("file_id", "file_hash", F.sha2("text", 256).alias("digest"))


@query(
    "F45_line_diff",
    WHOLE
    + """, p as (select a.file_id, string_split(a.text, chr(10)) as o, string_split(b.text, chr(10)) as n from f a join f b on a.file_id = b.file_id and a.file_hash < b.file_hash)
select file_id, len(list_filter(range(1, greatest(len(o), len(n)) + 1), lambda i: i > len(o))) as added, len(list_filter(range(1, greatest(len(o), len(n)) + 1), lambda i: i > len(n))) as removed,
  len(list_filter(range(1, least(len(o), len(n)) + 1), lambda i: o[i] <> n[i])) as modified from p""",
)
def _(t: Tables) -> DataFrame:
    whole = K.whole_texts(t.chunks, "file_id", "file_hash")
    pairs = whole.join(whole.select("file_id", F.col("file_hash").alias("h2"), F.col("text").alias("t2")), "file_id").where(F.col("file_hash") < F.col("h2"))
    return pairs.select("file_id", X.line_changes(F.col("text"), F.col("t2")).alias("d")).select("file_id", "d.*")


@query("W09_line_numbers", "select doc_id, length(substr(text, 1, 500)) - length(replace(substr(text, 1, 500), chr(10), '')) + 1 as line from documents where text is not null")
def _(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").select("doc_id", X.line_number(F.col("text"), F.lit(500)).alias("line"))


# ------------------------------------------------------------------ predicates and joins


@query("P01_unchanged_skipped", "select c.file_id, c.relative_path, c.hash from files c where (c.relative_path, c.hash) not in (select relative_path, file_hash from chunks where repo_id > 30)")
def _(t: Tables) -> DataFrame:
    done = t.chunks.where("repo_id > 30").select("relative_path", F.col("file_hash").alias("hash"))
    return C.without(t.files.select("file_id", "relative_path", "hash"), done, "relative_path", "hash")


@query("P02_within_token_limit", "select chunk_id, size from chunks where ceil(length(content) / 4) <= 256")
def _(t: Tables) -> DataFrame:
    return t.chunks.where(X.tokens_estimated(F.col("content")) <= 256).select("chunk_id", "size")


@query("P05_one_file", "select chunk_id from chunks where relative_path = (select min(relative_path) from chunks)")
def _(t: Tables) -> DataFrame:
    one = t.chunks.agg(F.min("relative_path").alias("p"))  # one row
    return t.chunks.join(F.broadcast(one), F.col("relative_path") == F.col("p")).select("chunk_id")


@query("P11_significant", r"select file_id, regexp_matches(relative_path, 'package\.json$|(?i:README)|(?i:config)|\.(js|ts|py|java|cpp|c|cs)$') as significant from files")
def _(t: Tables) -> DataFrame:
    return t.files.select("file_id", C.significant(F.col("relative_path")).alias("significant"))


@query(
    "P12_file_categories",
    r"""select file_id, regexp_extract(relative_path, '([^/]*)$', 1) in ('package.json', 'requirements.txt', 'Cargo.toml', 'pom.xml', 'build.gradle') as package,
  contains(lower(relative_path), 'config') or regexp_matches(relative_path, '(\.env|\.gitignore|\.eslintrc|tsconfig\.json)$') as config,
  regexp_matches(lower(relative_path), 'readme|doc') or ends_with(relative_path, '.md') as documentation from files""",
)
def _(t: Tables) -> DataFrame:
    p, low = F.col("relative_path"), F.lower("relative_path")
    return t.files.select(
        "file_id",
        F.regexp_extract(p, "([^/]*)$", 1).isin("package.json", "requirements.txt", "Cargo.toml", "pom.xml", "build.gradle").alias("package"),
        (low.contains("config") | p.rlike(r"(\.env|\.gitignore|\.eslintrc|tsconfig\.json)$")).alias("config"),
        (low.rlike("readme|doc") | p.endswith(".md")).alias("documentation"),
    )


@query("P15_healthy", "select event_type, count(*) filter (event_type <> 'error' or value < 20) as healthy, count(*) as n from events group by 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count_if((F.col("event_type") != "error") | (F.col("value") < 20)).alias("healthy"), F.count("*").alias("n"))


@query("P17_scope", "select c.chunk_id, r.alias from chunks c join repositories r using (repo_id) where r.primary_language = 'java'")
def _(t: Tables) -> DataFrame:
    scope = t.repositories.where("primary_language = 'java'").select("repo_id", "alias")
    return t.chunks.select("repo_id", "chunk_id").join(scope, "repo_id").select("chunk_id", "alias")


@query("J01_catalog_with_vectors", "select e.entry_id, v.vec_id from index_entries e join embedded_chunks v on v.chunk_id = e.entry_id")
def _(t: Tables) -> DataFrame:
    return t.index_entries.select("entry_id").join(t.embedded_chunks.select("vec_id", F.col("chunk_id").alias("entry_id")), "entry_id")


@query("J03_results_enriched", "select s.query_id, s.hit_no, s.chunk_id, coalesce(e.rel_path, 'unknown') as path, coalesce(nullif(e.code_language, ''), 'unknown') as language from search_results s left join (select entry_id, min(rel_path) as rel_path, min(code_language) as code_language from index_entries group by 1) e on e.entry_id = s.chunk_id")
def _(t: Tables) -> DataFrame:
    names = t.index_entries.groupBy("entry_id").agg(F.min("rel_path").alias("rel_path"), F.min("code_language").alias("code_language"))
    out = t.search_results.join(names, F.col("entry_id") == F.col("chunk_id"), "left")
    return out.select("query_id", "hit_no", "chunk_id", F.coalesce("rel_path", F.lit("unknown")).alias("path"), F.coalesce(F.nullif("code_language", F.lit("")), F.lit("unknown")).alias("language"))


def _states(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.documents.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", "text", "n_chars", "created_at")
    old = d.where("doc_id % 7 <> 0").select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.col("n_chars").alias("size"), F.col("created_at").alias("last_modified"))
    new = d.where("doc_id % 5 <> 0").select("path", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 11 == 0, "x").otherwise("")), 256).alias("hash"), (F.col("n_chars") + F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)).alias("size"), F.col("created_at").alias("last_modified"))
    return old, new


_STATES = """with d as (select source || '/' || doc_id as path, * from documents),
o as (select path, sha256(coalesce(text, '')) as hash, n_chars as size, created_at as last_modified from d where doc_id % 7 <> 0),
n as (select path, sha256(coalesce(text, '') || case when doc_id % 11 = 0 then 'x' else '' end) as hash, n_chars + case when doc_id % 11 = 0 then 1 else 0 end as size, created_at as last_modified from d where doc_id % 5 <> 0)
"""
_CHANGE = "case when o.path is null then 'added' when n.path is null then 'deleted' when o.hash = n.hash then 'unchanged' else 'modified' end"


@query("J04_changes", _STATES + f"select coalesce(n.path, o.path) as path, {_CHANGE} as change from n full join o on n.path = o.path")
def _(t: Tables) -> DataFrame:
    return C.changes(*_states(t))


@query("J05_cache_probe", "with c as (select distinct sha256(text) as key from documents where doc_id % 2 = 0 and text is not null) select doc_id, c.key is not null as hit from documents d left join c on c.key = sha256(d.text) where text is not null")
def _(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null")
    cache = d.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("key"), F.lit(True).alias("_hit")).distinct()
    return d.select("doc_id", F.sha2("text", 256).alias("key")).join(cache, "key", "left").select("doc_id", F.col("_hit").isNotNull().alias("hit"))


@query("J07_hash_check", _STATES + "select o.path, case when n.path is null then 'missing' when n.hash = o.hash then 'valid' else 'invalid' end as state from o left join n on n.path = o.path")
def _(t: Tables) -> DataFrame:
    return C.hash_check(*_states(t))


@query("J08_stat_check", _STATES + "select n.path, case when o.path is null then 'new' when n.size is not distinct from o.size and n.last_modified is not distinct from o.last_modified then 'unchanged' else 'potential' end as state from n left join o on n.path = o.path")
def _(t: Tables) -> DataFrame:
    return C.stat_check(*_states(t))


@query("J09_resume", _STATES + "select path, size from n where path not in (select path from o)")
def _(t: Tables) -> DataFrame:
    old, new = _states(t)
    return C.without(new, old, "path").select("path", "size")


@query("J10_orphans", _STATES + "select path, size from o where path in (select path from n)")
def _(t: Tables) -> DataFrame:
    old, new = _states(t)
    return C.only(old, new, "path").select("path", "size")


@query("J11_upsert", _STATES + "select path, hash from n union all select path, hash from o where path not in (select path from n)")
def _(t: Tables) -> DataFrame:
    old, new = _states(t)
    return C.upserted(old, new, "path").select("path", "hash")


@query("J16_provider_chain", "with p as (select event_type as t, row_number() over (order by event_type) as i from (select distinct event_type from events)) select a.t as start, b.t as provider, row_number() over (partition by a.t order by case when b.t = a.t then 0 else 1 end, b.t desc) as place from p a cross join p b")
def _(t: Tables) -> DataFrame:
    names = t.events.agg(F.sort_array(F.collect_set("event_type"), False).alias("every"))  # a row of the few types
    chain = names.select(F.explode("every").alias("start"), "every").withColumn("chain", F.array_distinct(F.concat(F.array("start"), F.col("every"))))
    return chain.select("start", F.posexplode("chain").alias("p", "provider")).select("start", "provider", (F.col("p") + 1).alias("place"))


@query("U02_union_of_sets", "select distinct lang from documents where doc_kind = 'readme' union select distinct lang from documents where doc_kind = 'commit'")
def _(t: Tables) -> DataFrame:
    d = t.documents
    return d.where("doc_kind = 'readme'").select("lang").union(d.where("doc_kind = 'commit'").select("lang")).distinct()


@query("U03_difference", _STATES + "select path from o except select path from n")
def _(t: Tables) -> DataFrame:
    old, new = _states(t)
    return old.select("path").subtract(new.select("path"))


@query("U05_distinct", "select distinct repo_id, extension from files")
def _(t: Tables) -> DataFrame:
    return t.files.select("repo_id", "extension").distinct()


@query("U06_change_stream", _STATES + f"select change, count(*) as n from (select {_CHANGE} as change from n full join o on n.path = o.path) where change <> 'unchanged' group by 1")
def _(t: Tables) -> DataFrame:
    return C.changes(*_states(t)).where("change <> 'unchanged'").groupBy("change").agg(F.count("*").alias("n"))


@query("W01_context", "with d as (select doc_id, string_split(text, chr(10)) as l from documents where text is not null) select doc_id, array_to_string(l[greatest(1, 5 - 2):4], chr(10)) as before, array_to_string(l[9:10], chr(10)) as after from d where len(l) >= 9")
def _(t: Tables) -> DataFrame:
    d = t.documents.where("text is not null").where(F.size(X.lines_of(F.col("text"))) >= 9)
    around = K.surrounding(F.col("text"), F.lit(5), F.lit(8))
    return d.select("doc_id", F.array_join(around["before"], "\n").alias("before"), F.array_join(around["after"], "\n").alias("after"))


@query(
    "W11_token_batches",
    """with recursive s as (select file_id, file_hash, list(ceil(length(content) / 4)::int order by ordinal, chunk_id) as n from (select distinct file_id, file_hash, ordinal, chunk_id, content from chunks where content is not null) group by all),
r(file_id, file_hash, i, batch, total) as (
  select file_id, file_hash, 1, 0, n[1] from s
  union all
  select r.file_id, r.file_hash, i + 1, case when total + n[i + 1] > 600 then batch + 1 else batch end, case when total + n[i + 1] > 600 then n[i + 1] else total + n[i + 1] end
  from r join s using (file_id, file_hash) where i < len(n))
select file_id, file_hash, i - 1 as item, batch from r""",
)
def _(t: Tables) -> DataFrame:
    sizes = t.chunks.where("content is not null").select("file_id", "file_hash", "ordinal", "chunk_id", X.tokens_estimated(F.col("content")).alias("n")).distinct()
    lists = sizes.groupBy("file_id", "file_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id", "n"))), lambda x: x["n"]).alias("sizes"))
    return lists.select("file_id", "file_hash", F.posexplode(K.token_batches(F.col("sizes"), 600)).alias("item", "batch"))
