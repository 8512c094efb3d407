"""Package manifests, tool configurations, symbol indexes and catalogs as nodes and edges.

Text formats are parsed by one Arrow pass that emits plain rows; what crosses files (names to
packages, symbols to definitions) is a join.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions.ids import make_id, normalize_id
from nodeloom.functions.text import strip_version
from nodeloom.operators.build import sanitize_label
from nodeloom.operators.symbols import resolve_targets, stem
from nodeloom.schema import basename

MOST_BYTES, MOST_SERVERS = 1 << 20, 200
CONFIG_NAMES = [".mcp.json", "claude_desktop_config.json", "mcp.json", "mcp_servers.json"]
ECOSYSTEMS = {"apm.yml": "apm", "pyproject.toml": "python", "go.mod": "go", "pom.xml": "maven"}


def block_yaml(lines: list[tuple[int, str]]):
    """Value of a block of (indent, text) lines of the YAML that manifests are written in: nested
    mappings, lists and plain or quoted scalars; anything else stays text."""
    entries: list[tuple[str, list[tuple[int, str]]]] = []
    for indent, text in lines:
        if indent <= lines[0][0] or not entries:
            entries.append((text, []))
        else:
            entries[-1][1].append((indent, text))
    if entries and entries[0][0].startswith("-"):
        return [block_yaml([(0, t[1:].strip()), *more]) if _KEY.match(t[1:].strip()) else _scalar(t[1:]) for t, more in entries]
    out = {}
    for text, more in entries:
        key = _KEY.match(text)
        if key:
            out.setdefault(_scalar(key[1]), _scalar(key[2]) if _scalar(key[2]) or not more else block_yaml(more))
    return out


_KEY = re.compile(r"""((?:"[^"]*"|'[^']*'|[^\s"'#:-][^#:]*))\s*:(?:\s+(.*)|$)""")


def _scalar(text: str | None) -> str:
    text = re.sub(r"(^|\s+)#.*$", "", text or "").strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'" else text


def parse_apm(text: str) -> tuple[str | None, list[str]]:
    """Dependencies are a list of names (or of one-key mappings) or a mapping by name."""
    rows = [(2 * (len(x) - len(x.lstrip())) + x.lstrip().startswith("-"), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith(("#", "---"))]
    data = block_yaml(rows) if rows else {}
    if not isinstance(data, dict):
        return None, []
    deps = data.get("dependencies") or []
    names = list(deps) if isinstance(deps, dict) else [next(iter(d), "") if isinstance(d, dict) else d for d in deps] if isinstance(deps, list) else []
    return data.get("name") or None, names


def parse_pyproject(text: str) -> tuple[str | None, list[str]]:
    import tomllib

    data = tomllib.loads(text)
    project, poetry = data.get("project") or {}, (data.get("tool") or {}).get("poetry") or {}
    deps = [re.split(r"[\s<>=!~;\[(]", d.strip(), maxsplit=1)[0] for d in project.get("dependencies") or [] if isinstance(d, str)]
    return project.get("name") or poetry.get("name"), deps + [d for d in poetry.get("dependencies") or {} if d.lower() != "python"]


def parse_gomod(text: str) -> tuple[str | None, list[str]]:
    module = re.search(r"(?m)^\s*module\s+(\S+)", text)
    blocks = re.findall(r"(?ms)^\s*require\s*\(\s*$(.*?)^\s*\)", text)
    deps = re.findall(r"(?m)^\s*(\S+)\s+v\S+", "\n".join(blocks)) + re.findall(r"(?m)^\s*require\s+(\S+)\s+v\S+", text)
    return (module[1] if module else None), deps


def parse_pom(text: str) -> tuple[str | None, list[str]]:
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]*"', "", text, count=1))
    full = lambda e: ":".join(filter(None, (e.findtext("groupId"), e.findtext("artifactId")))) if e.findtext("artifactId") else None
    return full(root), [x for x in map(full, root.findall(".//dependencies/dependency")) if x]


def parse_cargo(text: str) -> tuple[str | None, list[str]]:
    import tomllib

    data = tomllib.loads(text)
    return (data.get("package") or {}).get("name"), sorted(data.get("dependencies") or {})


_PARSERS = {"apm": parse_apm, "python": parse_pyproject, "go": parse_gomod, "maven": parse_pom, "cargo": parse_cargo}


def _parsed(files: DataFrame, ecosystems: dict[str, str]) -> DataFrame:
    """(path, ecosystem, name, deps) of readable manifests up to the size cap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, text in zip(b.path, b.text):
                eco = ecosystems.get(path.rsplit("/", 1)[-1])
                try:
                    name, deps = _PARSERS[eco](text)
                except Exception:  # a broken manifest says nothing
                    continue
                if isinstance(name, str) and name:
                    rows.append((path, eco, name, [d for d in deps if d]))
            yield pd.DataFrame(rows, columns=["path", "ecosystem", "name", "deps"])

    picked = files.where(basename(F.col("path")).isin(*ecosystems)).where(F.octet_length("text") <= MOST_BYTES)
    return picked.select("path", "text").mapInPandas(run, "path string, ecosystem string, name string, deps array<string>")


def packages(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of package manifests: one node per package name, depends_on edges to the
    canonical ids of its dependencies, whether or not those are in the corpus."""
    rows = _parsed(files, ECOSYSTEMS)
    pkg = lambda c: make_id(F.lit("pkg"), F.col(c))
    nodes = rows.select(pkg("name").alias("id"), F.col("name").alias("label"), F.lit("code").alias("file_type"), "ecosystem", F.col("path").alias("source_file"))
    edges = rows.select(pkg("name").alias("source"), F.explode(F.array_distinct("deps")).alias("dep"), F.col("path").alias("source_file")).withColumn("target", pkg("dep"))
    return nodes, edges.where("source <> target").select("source", "target", F.lit("depends_on").alias("relation"), F.lit("EXTRACTED").alias("confidence"), "source_file").distinct()


def crates(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): crates of a workspace and the dependencies between them; others are out."""
    rows = _parsed(files, {"Cargo.toml": "cargo"})
    nodes = rows.select(F.concat(F.lit("crate:"), "name").alias("id"), F.col("name").alias("label"), F.col("path").alias("source_file"))
    deps = rows.select("name", F.explode("deps").alias("dep"), F.col("path").alias("source_file")).join(rows.select(F.col("name").alias("dep")).distinct(), "dep", "left_semi")
    return nodes, deps.select(F.concat(F.lit("crate:"), "name").alias("source"), F.concat(F.lit("crate:"), "dep").alias("target"), F.lit("crate_depends_on").alias("relation"), "source_file").distinct()


# A package's name by the public registry's rule; a server's package is scoped or has
# "mcp" at one end of its name.
_PACKAGE = r"[a-z0-9][a-z0-9._-]*"
_SERVER_PACKAGE = rf"^(@{_PACKAGE}/{_PACKAGE}|{_PACKAGE}-mcp(-[a-z0-9._-]+)?|mcp-{_PACKAGE})(@\S+)?$"


def package_argument(args):
    """The first argument that looks like a package, without its version; flags are skipped."""
    return F.try_element_at(F.transform(F.filter(F.transform(args, F.trim), lambda a: ~a.rlike(r"^-{1,2}\w") & a.rlike(_SERVER_PACKAGE)), strip_version), F.lit(1))


def server_configs(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of tool server configurations: servers, commands, packages and the *names*
    of environment variables. Their values are not even parsed into a column."""
    kind, server = "map<string,string>", "command string, args array<string>, env map<string,string>"
    picked = files.where(basename(F.col("path")).isin(*CONFIG_NAMES)).where(F.octet_length("text") <= MOST_BYTES)
    doc = picked.select("path", F.from_json("text", f"mcpServers {kind}, mcp struct<servers:{kind}>").alias("d"))
    servers = doc.select("path", F.slice(F.map_entries(F.coalesce("d.mcpServers", "d.mcp.servers")), 1, MOST_SERVERS).alias("s"))
    # each entry on its own, so that a broken one doesn't take the others with it
    rows = servers.select("path", F.explode("s").alias("e")).where("e.key <> '' AND ltrim(e.value) LIKE '{%'")
    rows = rows.select("path", F.col("e.key").alias("server"), F.from_json("e.value", server).alias("v"))
    rows = rows.select("path", "server", F.col("v.command").alias("command"), package_argument(F.col("v.args")).alias("package"), F.map_keys("v.env").alias("env"))
    rows = rows.select("*", normalize_id("path").alias("file_id"), make_id(stem(F.col("path")), F.lit("server"), F.col("server")).alias("server_id"))
    name = basename(F.col("command"))
    one = lambda kind, nid, label, rel: F.struct(F.lit(kind).alias("kind"), nid.alias("id"), label.alias("label"), F.lit(rel).alias("relation"))
    ends = F.concat(
        F.array(one("mcp_command", make_id(F.lit("mcp_command"), name), name, "references"), one("mcp_package", make_id(F.lit("mcp_package"), F.col("package")), F.col("package"), "references")),
        F.transform(F.coalesce("env", F.array().cast("array<string>")), lambda e: F.struct(F.lit("env_var").alias("kind"), F.concat(F.lit("env_var_"), F.lower(e)).alias("id"), e.alias("label"), F.lit("requires_env").alias("relation"))),
    )
    out = rows.select("path", "server_id", F.explode(ends).alias("x")).where("x.label <> ''")
    nodes = rows.select("path", F.lit("mcp_server").alias("kind"), F.col("server_id").alias("id"), F.col("server").alias("label"))
    nodes = nodes.unionByName(out.select("path", "x.kind", "x.id", "x.label")).unionByName(rows.select("path", F.lit("mcp_config_file").alias("kind"), F.col("file_id").alias("id"), basename(F.col("path")).alias("label")))
    nodes = nodes.groupBy("id").agg(F.min(F.struct("path", "kind", "label")).alias("x")).select("id", "x.kind", sanitize_label(F.col("x.label")).alias("label"), F.col("x.path").alias("source_file"))
    edges = rows.select(F.col("file_id").alias("source"), F.col("server_id").alias("target"), F.lit("contains").alias("relation"), F.col("path").alias("source_file"))
    return nodes, edges.unionByName(out.select(F.col("server_id").alias("source"), F.col("x.id").alias("target"), F.col("x.relation").alias("relation"), F.col("path").alias("source_file"))).distinct()


_SYMBOL = "symbol string, kind string, display_name string, relationships array<map<string,string>>, occurrences array<struct<range:array<int>>>"


def symbol_index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of symbol index documents (text): symbols and their relationships, targets
    in the same document first, else unique, else a stub. Flags only count as JSON true."""
    kind = "array<struct<" + ",".join(f.replace(" ", ":", 1) for f in _SYMBOL.split(", ")) + ">>"
    rows = docs.select(F.explode(F.from_json("text", f"documents array<struct<relative_path:string,language:string,symbols:{kind}>>")["documents"]).alias("d"))
    rows = rows.select(F.coalesce("d.relative_path", F.lit("")).alias("doc"), F.col("d.language").alias("language"), F.explode("d.symbols").alias("s")).where("s.symbol <> ''")
    tail = F.lower(F.regexp_replace(F.regexp_replace(F.substring_index("s.symbol", "#", -1), "[^a-zA-Z0-9_]", "_"), "^_+|_+$", ""))
    h = F.substring(F.sha1(F.concat("doc", F.lit(":"), "s.symbol").cast("binary")), 1, 12)
    rows = rows.withColumn("id", F.when(tail != "", F.concat(F.lit("scip_"), tail, F.lit("_"), h)).otherwise(F.concat(F.lit("scip_"), h)))
    line = F.get(F.get("s.occurrences", F.lit(0))["range"], F.lit(0))
    nodes = rows.groupBy("id").agg(F.min(F.struct(F.coalesce("s.display_name", "s.symbol").alias("label"), "doc", F.concat(F.lit("L"), F.greatest(F.coalesce(line, F.lit(0)), F.lit(0)) + 1).alias("source_location"))).alias("x")).select("id", "x.label", F.col("x.doc").alias("source_file"), "x.source_location")
    rel = rows.select("id", "doc", F.explode("s.relationships").alias("r")).where("r['symbol'] <> ''")
    flag = lambda n: F.coalesce(F.col("r")[n] == "true", F.lit(False))
    relation = F.when(flag("is_implementation"), "scip_impl").when(flag("is_type_definition"), "scip_typed").when(flag("is_definition"), "scip_def").otherwise("scip_ref")
    rel = rel.select(F.struct("id", relation.alias("relation"), "doc").alias("ref"), "doc", F.col("r")["symbol"].alias("symbol"))
    found = resolve_targets(rel, rows.select("doc", F.col("s.symbol").alias("symbol"), "id"))
    return nodes, found.select(F.col("ref.id").alias("source"), "target", F.col("ref.relation").alias("relation"), F.col("ref.doc").alias("source_file")).distinct()


#: What a view's or routine's text reads: names behind FROM and JOIN, comments and strings taken out.
_READS = r"(?i)\b(?:from|join)\s+((?:\"[^\"]+\"|\w+)(?:\.(?:\"[^\"]+\"|\w+))?)"


def catalog_graph(tables: DataFrame, foreign_keys: DataFrame, views: DataFrame | None = None, routines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of database catalog rows: tables (schema, name, type), foreign keys
    (constraint, schema, table, foreign_schema, foreign_table), views (schema, name, definition),
    routines (schema, name, type, definition, language).

    Views and routines read the tables and views that their text names, with or without a schema
    (their own first, then the only one that has the name); without a text they read nothing."""
    nid = lambda s, t: make_id(F.col(s), F.col(t))
    node = lambda df, kind, mark="": df.select(nid("schema", "name").alias("id"), F.concat("schema", F.lit("."), "name", F.lit(mark)).alias("label"), kind.alias("kind"))
    nodes = node(tables, F.lower("type"))
    edges = foreign_keys.select(nid("schema", "table").alias("source"), nid("foreign_schema", "foreign_table").alias("target"), F.lit("references").alias("relation"), F.col("constraint").alias("context"))
    readers = [df.select("schema", "name", "definition") for df in (views, routines) if df is not None]
    if views is not None:
        nodes = nodes.unionByName(node(views, F.lit("view")))
    known = nodes.where("kind <> 'routine'").select("id").distinct()
    named = tables.select("schema", "name") if views is None else tables.select("schema", "name").unionByName(views.select("schema", "name"))
    if routines is not None:
        nodes = nodes.unionByName(node(routines.where("type IN ('FUNCTION', 'PROCEDURE')"), F.lower("type"), "()"))
    for df in readers:
        text = F.regexp_replace(F.coalesce("definition", F.lit("")), r"(?s)--[^\n]*|/\*.*?\*/|'[^']*'", " ")
        reads = df.select("schema", nid("schema", "name").alias("source"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(_READS), 1))).alias("ref"))
        parts = F.split(F.replace("ref", F.lit('"')), r"\.")
        reads = reads.select("source", "schema", F.when(F.size(parts) > 1, parts[0]).alias("given"), F.element_at(parts, -1).alias("name"))
        only = named.distinct().groupBy(F.lower("name").alias("low")).agg(F.count("*").alias("n"), F.min("schema").alias("other"))
        own = make_id(F.coalesce("given", "schema"), F.col("name"))
        rows = reads.withColumn("own", own).join(known.withColumnsRenamed({"id": "own"}).withColumn("there", F.lit(True)), "own", "left").join(only, F.lower("name") == F.col("low"), "left")
        target = F.when(F.col("there"), F.col("own")).when(F.col("given").isNull() & (F.col("n") == 1), make_id(F.col("other"), F.col("name")))
        rows = rows.select("source", target.alias("target"), F.lit("reads_from").alias("relation"), F.lit(None).cast("string").alias("context"))
        edges = edges.unionByName(rows.where("target IS NOT NULL AND source <> target"))
    return nodes, edges.distinct()


def read_catalog(spark: SparkSession, url: str, **options: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Catalog rows of a database over JDBC, in the order of :func:`catalog_graph`'s arguments;
    needs its driver."""
    reader = spark.read.format("jdbc").option("url", url)
    for k, v in options.items():
        reader = reader.option(k, v)
    load = lambda query: reader.option("query", query).load()
    user = "NOT IN ('pg_catalog', 'information_schema')"
    tables = load(f"SELECT table_schema AS schema, table_name AS name, table_type AS type FROM information_schema.tables WHERE table_type <> 'VIEW' AND table_schema {user}")
    keys = load("SELECT c.constraint_name AS constraint, c.table_schema AS schema, c.table_name AS table, u.table_schema AS foreign_schema, u.table_name AS foreign_table FROM information_schema.table_constraints c JOIN information_schema.constraint_column_usage u ON u.constraint_name = c.constraint_name WHERE c.constraint_type = 'FOREIGN KEY'")
    views = load(f"SELECT table_schema AS schema, table_name AS name, view_definition AS definition FROM information_schema.views WHERE table_schema {user}")
    routines = load(f"SELECT routine_schema AS schema, routine_name AS name, routine_type AS type, routine_definition AS definition, external_language AS language FROM information_schema.routines WHERE routine_schema {user}")
    return tables, keys, views, routines
