"""Project summaries: languages, directories, technologies, components and patterns of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import half_up

#: Technologies that a file name or path part shows, as they stand (a star is no wildcard: it stands for itself).
FILE_TECHNOLOGIES = {
    "npm": ("package.json", "package-lock.json"),
    "yarn": ("yarn.lock", ".yarnrc"),
    "pnpm": ("pnpm-lock.yaml", ".pnpmrc"),
    "pip": ("requirements.txt", "Pipfile", "pyproject.toml"),
    "composer": ("composer.json", "composer.lock"),
    "maven": ("pom.xml",),
    "gradle": ("build.gradle", "gradle.properties"),
    "cargo": ("Cargo.toml", "Cargo.lock"),
    "go-modules": ("go.mod", "go.sum"),
    "bundler": ("Gemfile", "Gemfile.lock"),
    "ibm-ace": ("*.msgflow", "*.esql", "*.bar", "*.appzip", "broker.xml"),
    "msgflow": ("*.msgflow",),
    "esql": ("*.esql",),
    "mulesoft": ("*.xml", "*.dwl", "mule-artifact.json", "mule-app.properties"),
    "dataweave": ("*.dwl",),
    "webpack": ("webpack.config.js", "webpack.config.ts"),
    "vite": ("vite.config.js", "vite.config.ts"),
    "rollup": ("rollup.config.js",),
    "parcel": (".parcelrc",),
    "gulp": ("gulpfile.js",),
    "grunt": ("Gruntfile.js",),
    "jest": ("jest.config.js", "jest.config.json"),
    "vitest": ("vitest.config.js", "vitest.config.ts"),
    "mocha": (".mocharc.json", "mocha.opts"),
    "cypress": ("cypress.config.js", "cypress.json"),
    "playwright": ("playwright.config.js", "playwright.config.ts"),
    "docker": ("Dockerfile", "docker-compose.yml", ".dockerignore"),
    "kubernetes": ("deployment.yaml", "service.yaml", "ingress.yaml"),
    "terraform": ("main.tf", "variables.tf", "outputs.tf"),
    "github-actions": (".github/workflows",),
    "gitlab-ci": (".gitlab-ci.yml",),
    "jenkins": ("Jenkinsfile",),
    "travis": (".travis.yml",),
    "eslint": (".eslintrc.js", ".eslintrc.json", ".eslintrc.yml"),
    "prettier": (".prettierrc", "prettier.config.js"),
    "stylelint": (".stylelintrc", "stylelint.config.js"),
    "typescript": ("tsconfig.json", "tsconfig.build.json"),
    "prisma": ("schema.prisma",),
    "sequelize": (".sequelizerc",),
    "typeorm": ("ormconfig.json",),
    "vercel": ("vercel.json",),
    "netlify": ("netlify.toml", "_redirects"),
    "aws": ("serverless.yml", "sam.yaml"),
}
#: Technologies of file endings.
ENDING_TECHNOLOGIES = {
    ".js": "javascript", ".ts": "typescript", ".jsx": "react", ".tsx": "react", ".vue": "vue", ".py": "python", ".java": "java", ".kt": "kotlin", ".scala": "scala", ".rb": "ruby", ".php": "php", ".go": "go", ".rs": "rust", ".swift": "swift", ".cs": "csharp", ".cpp": "cpp", ".c": "c",
    ".html": "html", ".css": "css", ".msgflow": "msgflow", ".esql": "esql", ".dwl": "dataweave", ".mflow": "mulesoft", ".dart": "dart", ".yaml": "yaml", ".yml": "yaml", ".template": "cloudformation", ".scss": "sass", ".less": "less", ".sql": "sql", ".sh": "bash", ".ps1": "powershell",
    ".dockerfile": "docker",
}
#: Technologies that a text shows (regular expressions without regard to case).
CONTENT_TECHNOLOGIES = {
    "react": (r"import.*react", r"from ['\"]react['\"]", r"React\.", r"jsx"),
    "vue": (r"import.*vue", r"from ['\"]vue['\"]", r"<template>", r"Vue\."),
    "angular": (r"@angular", r"@Component", r"@Injectable", r"import.*@angular"),
    "svelte": (r"import.*svelte", r"<script>", r"\.svelte"),
    "express": (r"require\(['\"]express['\"]\)", r"import.*express", r"app\.get\(", r"app\.post\("),
    "fastapi": (r"from fastapi", r"import FastAPI", r"@app\."),
    "django": (r"from django", r"import django", r"django\.conf"),
    "flask": (r"from flask", r"import Flask", r"@app\.route"),
    "spring": (r"@SpringBootApplication", r"@RestController", r"import org\.springframework"),
    "mongodb": (r"mongodb", r"mongoose", r"MongoClient"),
    "postgresql": (r"postgresql", r"psycopg2", r"pg\."),
    "mysql": (r"mysql", r"import mysql"),
    "redis": (r"redis", r"import redis"),
    "tailwind": (r"tailwindcss", r"tailwind\.config", r"class=\".*\b(?:bg-|text-|p-|m-|w-|h-)"),
    "bootstrap": (r"bootstrap", r"class=\".*\b(?:btn|col-|row|container)"),
    "material-ui": (r"@mui", r"@material-ui", r"import.*@mui"),
    "redux": (r"redux", r"useSelector", r"useDispatch"),
    "mobx": (r"mobx", r"@observable", r"@action"),
    "zustand": (r"zustand", r"create\("),
    "jest": (r"describe\(", r"it\(", r"test\(", r"expect\("),
    "cypress": (r"cy\.", r"describe\(", r"it\("),
    "aws": (r"aws-sdk", r"import.*aws", r"AWS\."),
    "gcp": (r"google-cloud", r"from google\.cloud"),
    "azure": (r"azure", r"import.*azure"),
    "ibm-ace": (r"CREATE\s+MODULE", r"BROKER\s+SCHEMA", r"DECLARE\s+NAMESPACE", r"CREATE\s+PROCEDURE", r"CREATE\s+FUNCTION", r"ESQL"),
    "msgflow": (r"<\?xml", r"<MessageFlow", r"<ComputeNode", r"<FilterNode", r"<MQInput"),
    "esql": (r"CREATE\s+MODULE", r"BROKER\s+SCHEMA", r"DECLARE\s+NAMESPACE"),
    "mulesoft": (r"<mule", r"xmlns:mule", r"<flow\s+name", r"<http:listener", r"<db:select"),
    "dataweave": (r"output\s+application/json", r"input\s+payload", r"%dw\s+2\.0", r"mapObject", r"---"),
    "flutter": (r"import\s+'package:flutter", r"extends\s+StatelessWidget", r"extends\s+StatefulWidget", r"MaterialApp"),
    "dart": (r"void\s+main", r"import\s+'dart:", r"class\s+\w+\s+extends"),
    "cloudformation": (r"AWSTemplateFormatVersion", r"Resources:", r"Type:\s+AWS::", r"!Ref\s"),
}
#: These of the patterns above do regard case.
CASED = frozenset((r"React\.", r"Vue\.", r"!Ref\s"))
#: Packages whose presence in a manifest shows a technology.
DEPENDENCY_TECHNOLOGIES = {
    "react": ("react", "react-dom"),
    "vue": ("vue", "@vue/cli"),
    "angular": ("@angular/core", "@angular/cli"),
    "express": ("express",),
    "next.js": ("next",),
    "nuxt.js": ("nuxt",),
    "gatsby": ("gatsby",),
    "svelte": ("svelte",),
    "solid": ("solid-js",),
    "django": ("Django",),
    "flask": ("Flask",),
    "fastapi": ("fastapi",),
    "pandas": ("pandas",),
    "numpy": ("numpy",),
    "tensorflow": ("tensorflow",),
    "pytorch": ("torch",),
    "mulesoft-java": ("mule-core", "mule-module-http", "mule-transport-http", "mule-transport-jms"),
    "flutter": ("flutter", "flutter_bloc", "provider", "flutter_localizations"),
    "dart": ("dart_style", "analyzer", "build_runner"),
    "ibm-ace": ("integration-api", "integration-http", "integration-mq", "integration-file"),
    "aws-cdk": ("@aws-cdk/core", "aws-cdk-lib"),
    "cloudformation": ("cfn-lint", "aws-cf-template-flip"),
    "spring-boot": ("spring-boot-starter",),
    "hibernate": ("hibernate-core",),
    "asp.net": ("Microsoft.AspNetCore",),
    "entity-framework": ("Microsoft.EntityFrameworkCore",),
    "laravel": ("laravel/framework",),
    "symfony": ("symfony/symfony",),
    "rails": ("rails",),
    "sinatra": ("sinatra",),
    "gin": ("github.com/gin-gonic/gin",),
    "echo": ("github.com/labstack/echo",),
    "actix": ("actix-web",),
    "rocket": ("rocket",),
}
#: Tools that the scripts of a manifest show.
SCRIPT_TECHNOLOGIES = ("webpack", "vite", "jest")
#: The category of a technology; the rest are Other.
CATEGORIES = {
    "javascript": "Programming Languages", "typescript": "Programming Languages", "python": "Programming Languages", "java": "Programming Languages", "csharp": "Programming Languages", "go": "Programming Languages", "rust": "Programming Languages", "dart": "Programming Languages",
    "react": "Frontend Frameworks", "vue": "Frontend Frameworks", "angular": "Frontend Frameworks", "flutter": "Frontend Frameworks", "express": "Backend Frameworks", "django": "Backend Frameworks", "flask": "Backend Frameworks", "spring": "Backend Frameworks", "mulesoft": "Integration Platforms",
    "mongodb": "Databases", "postgresql": "Databases", "mysql": "Databases", "redis": "Databases", "webpack": "Build Tools", "vite": "Build Tools", "jest": "Testing", "cypress": "Testing", "docker": "DevOps", "kubernetes": "DevOps", "yaml": "DevOps",
    "aws": "Cloud Services", "gcp": "Cloud Services", "azure": "Cloud Services", "cloudformation": "Infrastructure as Code",
}
#: Kinds of directories by parts of their path, tried in this order.
DIRECTORY_KINDS = (("test", "test|spec"), ("documentation", "doc|readme"), ("configuration", "config|settings"), ("build", "build|dist|target"), ("assets", "asset|static|public"), ("dependencies", "node_modules|vendor"))
LAYERS = ("controller", "service", "repository", "model", "dao")


def directory_kind(path: Column) -> Column:
    out = F.lit("source")
    for kind, p in reversed(DIRECTORY_KINDS):
        out = F.when(F.lower(path).rlike(p), kind).otherwise(out)
    return out


def ancestors(path: Column) -> Column:
    """All directories above a file, from the first part on."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def directory_rollup(files: DataFrame, by: str, path: str) -> DataFrame:
    """(by, directory, files, depth, kind): each directory counts the files anywhere beneath it."""
    rows = files.select(by, F.explode(ancestors(F.col(path))).alias("directory")).groupBy(by, "directory").agg(F.count("*").alias("files"))
    return rows.withColumn("depth", F.size(F.split("directory", "/"))).withColumn("kind", directory_kind(F.col("directory")))


def primary(df: DataFrame, by: str, name: str, amount: str) -> DataFrame:
    """(by, name): the name with the greatest amount, ties by name; Unknown where all amounts are 0 or null."""
    ranked = df.groupBy(by).agg(F.min(F.struct((-F.coalesce(F.col(amount), F.lit(0))).alias("a"), F.col(name).alias("n"))).alias("v"))
    return ranked.select(by, F.when(F.col("v.a") < 0, F.col("v.n")).otherwise("Unknown").alias(name))


def project_score(files: Column, loc: Column, languages: Column, depth: Column) -> Column:
    part = lambda x, by, most: F.least(x / F.lit(float(by)), F.lit(float(most)))
    return F.least(F.greatest(half_up(part(files, 100, 3) + part(loc, 10000, 3) + part(languages, 3, 2) + part(depth, 5, 2)), F.lit(1)), F.lit(10))


def architecture(files: DataFrame, by: str, path: str) -> DataFrame:
    """(by, mvc, microservices, layered, modular, confidence) from the paths of each group."""
    low = F.lower(path)
    has = lambda w: F.bool_or(low.contains(w))
    parts = F.split(path, "/")
    out = files.groupBy(by).agg(
        (has("model") & has("view") & has("controller")).alias("mvc"),
        (F.count_if(low.contains("service") | low.contains("api")) > 3).alias("microservices"),
        (sum((F.when(has(x), 1).otherwise(0) for x in LAYERS), F.lit(0)) >= 3).alias("layered"),
        (F.count_distinct(F.when(F.size(parts) > 2, parts[1])) > 3).alias("modular"),
    )
    n = sum((F.col(c).cast("int") for c in ("mvc", "microservices", "layered", "modular")), F.lit(0))
    return out.withColumn("confidence", half_up(n * 25.0))


def technologies(files: DataFrame, by: str, path: str, ending: str) -> DataFrame:
    """(by, technology, confidence, score, detections, sources) from file names and endings.

    The rules are a fixed list of literals inside one array expression, so files meet them without a join.
    """
    rules = [(t, n.lower()) for t, names in FILE_TECHNOLOGIES.items() for n in names]
    named = F.filter(F.array(*[F.when(F.lower(path).contains(n), F.lit(t)) for t, n in rules]), lambda x: x.isNotNull())
    table = F.create_map(*[F.lit(x) for p in ENDING_TECHNOLOGIES.items() for x in p])
    own = F.try_element_at(table, F.lower(ending))
    hits = F.concat(
        F.transform(named, lambda t: F.struct(t.alias("technology"), F.lit("file-pattern").alias("source"), F.lit(0.8).alias("confidence"))),
        F.when(own.isNotNull(), F.array(F.struct(own.alias("technology"), F.lit("extension").alias("source"), F.lit(0.6).alias("confidence")))).otherwise(F.array().cast("array<struct<technology:string,source:string,confidence:double>>")),
    )
    rows = files.select(by, F.explode(hits).alias("h")).select(by, "h.*")
    return ranked(rows, by)


def content_technologies(df: DataFrame, by: str, text: str) -> DataFrame:
    """As technologies, from texts: each pattern of a technology that a text has is a detection."""
    rules = [(t, p if p in CASED else f"(?i){p}") for t, patterns in CONTENT_TECHNOLOGIES.items() for p in patterns]
    hits = F.filter(F.array(*[F.when(F.col(text).rlike(p), F.lit(t)) for t, p in rules]), lambda x: x.isNotNull())
    rows = df.select(by, F.explode(hits).alias("technology"), F.lit("content-pattern").alias("source"), F.lit(0.7).alias("confidence"))
    return ranked(rows, by)


def dependencies(df: DataFrame, by: str, path: str, text: str) -> DataFrame:
    """(by, path, manifest, scope, name, version) of every dependency that a manifest names.

    Manifests by the end of the path: package.json (dependencies, devDependencies, peerDependencies), requirements.txt,
    Cargo.toml (its dependencies section) and pom.xml. A manifest that is malformed names nothing. All in the JVM.
    """
    none = F.array().cast("array<struct<scope:string,name:string,version:string>>")
    one = lambda scope, name, version: F.struct(F.lit(scope).alias("scope"), name.alias("name"), version.cast("string").alias("version"))
    c, parsed = F.col(text), F.from_json(F.col(text), "dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>")
    scopes = ("dependencies", "devDependencies", "peerDependencies")
    section_of = lambda k: F.coalesce(F.transform(F.map_entries(parsed[k]), lambda e: one(k, e["key"], e["value"])), none)
    npm = F.concat(*[section_of(k) for k in scopes])
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"#.*$", ""))), lambda x: (F.length(x) > 0) & ~x.startswith("-"))
    pip = F.transform(lines, lambda x: one("dependencies", F.lower(F.trim(F.regexp_extract(x, r"^([^=><~!;\[\s]+)", 1))), F.nullif(F.regexp_extract(x, r"(?:==|>=|~=)\s*([^\s,;]+)", 1), F.lit(""))))
    section = F.regexp_extract(c, r"\[dependencies\]([\s\S]*?)(?=\n\[|\z)", 1)
    entries = F.regexp_extract_all(section, F.lit(r"(?m)^\s*([\w\-]+\s*=[^\n]*)"), 1)
    cargo = F.transform(entries, lambda x: one("dependencies", F.trim(F.regexp_extract(x, r"^([\w\-]+)", 1)), F.nullif(F.regexp_extract(x, r"\"([\d][^\"]*)\"", 1), F.lit(""))))
    blocks = F.regexp_extract_all(c, F.lit(r"<dependency>([\s\S]*?)</dependency>"), 1)
    tag = lambda x, n: F.trim(F.regexp_extract(x, rf"<{n}>([^<]*)</{n}>", 1))
    pom = F.transform(blocks, lambda x: one("dependencies", F.concat_ws(":", tag(x, "groupId"), tag(x, "artifactId")), F.nullif(tag(x, "version"), F.lit(""))))
    p = F.col(path)
    kinds = (("package.json", npm), ("requirements.txt", pip), ("Cargo.toml", cargo), ("pom.xml", pom))
    manifest, found = F.lit(None).cast("string"), none
    for name, value in kinds:
        manifest, found = F.when(p.endswith(name), name).otherwise(manifest), F.when(p.endswith(name), value).otherwise(found)
    rows = df.where(F.col(text).isNotNull() & p.rlike(r"(package\.json|requirements\.txt|Cargo\.toml|pom\.xml)$"))
    return rows.select(by, path, manifest.alias("manifest"), F.explode(found).alias("d")).select(by, path, "manifest", "d.*").where("name <> ''")


def dependency_technologies(df: DataFrame, by: str, path: str, text: str) -> DataFrame:
    """As technologies, from manifests: a package.json's names that hold a known package's or are held by it, its scripts; the
    names of a requirements.txt as they are; the names in a Cargo.toml or pom.xml that hold a known one."""
    rules = [(t, n) for t, names in DEPENDENCY_TECHNOLOGIES.items() for n in names]
    named = dependencies(df, by, path, text)
    name, npm = F.col("name"), F.col("manifest") == "package.json"
    hit = lambda n: F.when(npm, name.contains(n) | F.lit(n).contains(name)).when(F.col("manifest") == "requirements.txt", name == n.lower()).otherwise(name.contains(n))
    deps = named.select(by, F.explode(F.filter(F.array(*[F.when(hit(n), F.lit(t)) for t, n in rules]), lambda x: x.isNotNull())).alias("technology"), F.lit("dependency").alias("source"), F.lit(0.9).alias("confidence"))
    scripts = F.map_values(F.from_json(F.col(text), "scripts map<string,string>")["scripts"])
    tools = F.flatten(F.transform(scripts, lambda x: F.filter(F.array(*[F.when(x.contains(t), F.lit(t)) for t in SCRIPT_TECHNOLOGIES]), lambda y: y.isNotNull())))
    run = df.where(F.col(path).endswith("package.json")).select(by, F.explode(tools).alias("technology"), F.lit("script").alias("source"), F.lit(0.8).alias("confidence"))
    return ranked(deps.unionByName(run), by)


def ranked(rows: DataFrame, by: str) -> DataFrame:
    """Detections summed up: the greatest confidence times (1 + ln of the count); those up to 0.5 are dropped."""
    out = rows.groupBy(by, "technology").agg(F.max("confidence").alias("confidence"), F.count("*").alias("detections"), F.array_sort(F.collect_set("source")).alias("sources"))
    return out.where(F.col("confidence") > 0.5).withColumn("score", F.col("confidence") * (1 + F.ln(F.col("detections"))))


def category(technology: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CATEGORIES.items() for x in p]), technology), F.lit("Other"))
