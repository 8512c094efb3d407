"""The property graph as two DataFrames, and its fixed vocabularies."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the data model.
FILE_TYPES = ["code", "document", "paper", "image", "rationale", "concept"]
CONFIDENCES = ["EXTRACTED", "INFERRED", "AMBIGUOUS"]
FILE_TYPE_SYNONYMS = {
    "markdown": "document", "text": "document", "tool": "code", "library": "code", "pattern": "concept", "principle": "concept", "constraint": "concept",
    "tech": "concept", "technology": "concept", "data-source": "concept", "data_source": "concept", "gotcha": "concept", "framework": "concept",
}
DEFAULT_SCORES = {"EXTRACTED": 1.0, "INFERRED": 0.5, "AMBIGUOUS": 0.2}
IMPACT_RELATIONS = ["calls", "references", "imports", "imports_from", "re_exports", "inherits", "extends", "implements", "uses", "mixes_in", "embeds"]
STRUCTURAL_RELATIONS = ["imports", "imports_from", "contains", "method"]
#: Language families for building: C and C++ differ, an unknown suffix differs from a known one.
BUILD_FAMILIES = {
    "py": ".py .pyi", "js": ".js .mjs .cjs .jsx .ts .tsx", "go": ".go", "rs": ".rs", "jvm": ".java .kt .scala .groovy", "c": ".c .h", "cpp": ".cc .cpp .hpp",
    "rb": ".rb", "php": ".php", "cs": ".cs", "swift": ".swift", "lua": ".lua",
}
#: Language families for analysis: C and C++ are one, unknown suffixes never count as another language.
ANALYSIS_FAMILIES = {
    "python": ".py .pyw", "js": ".js .jsx .mjs .ejs .ts .tsx .vue .svelte", "go": ".go", "rust": ".rs", "jvm": ".java .kt .kts .scala", "c": ".c .h .cpp .cc .cxx .hpp",
    "ruby": ".rb", "swift": ".swift", "dotnet": ".cs", "php": ".php", "r": ".r",
}


@dataclass(frozen=True)
class Graph:
    """``nodes``: seq, id, label, file_type, source_file, source_location, community, repo.
    ``edges``: seq, source, target, relation, confidence, confidence_score, context, source_file, weight.
    ``seq`` is the order of insertion, by which ties are broken."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = False

    def with_(self, **kw) -> Graph:
        return replace(self, **kw)

    def links(self) -> DataFrame:
        """(u, v) of the edges of a simple graph."""
        return self.edges.select("u", "v")


def lookup(families: dict[str, str], suffix: Column) -> Column:
    """Family of a suffix, null if unknown."""
    out = None
    for family, suffixes in families.items():
        test = suffix.isin(*suffixes.split())
        out = F.when(test, family) if out is None else out.when(test, family)
    return out


def mapped(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def suffix(path: Column) -> Column:
    """Last suffix of a path's name in lower case, '' if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"[^/](\.[^./]+)$", 1))
