"""Kinds of corpora: a plug-in's methods return Columns, so a kind adds no Python to the plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as X


@dataclass(frozen=True)
class Kind:
    name: str
    extensions: tuple[str, ...]
    metadata: tuple[str, ...]
    public: tuple[str, ...]
    parsed: bool = False
    creatable: bool = True
    defaults: dict = field(default_factory=dict)

    def fields(self, filename: Column) -> dict[str, Column]:
        if self.parsed:
            return X.parse_filename(filename)
        return {"title": F.regexp_replace(filename, r"\.[^.]*$", "")}

    def embed_text(self, document: Column) -> Column:
        head = [F.lit("제목: "), F.coalesce(F.col("title"), F.lit(""))]
        if self.parsed:
            head += [F.lit(" | 분야: "), F.coalesce(F.col("category"), F.lit(""))]
        return F.concat(*head, F.lit("\n"), document)

    def where(self, options: dict) -> Column | None:
        """The filter that runs before top-k."""
        if self.parsed and not options.get("include_advisor_docs"):
            return F.col("doc_type") == X.MAIN_DOC
        return None

    def public_struct(self, columns: list[str]) -> Column:
        """Only public fields leave; an absent field is left out."""
        return F.struct(*(F.col(c) for c in self.public if c in columns))


INVENTION = Kind("invention", (".md",), ("title", "year", "category", "author", "doc_type"), ("title", "year", "category", "doc_type"), parsed=True, creatable=False)
PLAIN = Kind("plain", (".md", ".txt"), ("title",), ("title",))
MANAGED = Kind("easyflow", (".md", ".txt"), ("title", "source_id", "source_version_id", "operation_id", "page", "anchor"), ("title", "source_id", "source_version_id", "page", "anchor"))
KINDS = {k.name: k for k in (INVENTION, PLAIN, MANAGED)}


def compile_where(where: dict | None) -> Column:
    """The predicate language of the vector store: equality, $in, $and, $lt, $lte."""
    if not where:
        return F.lit(True)
    out = F.lit(True)
    for key, value in where.items():
        if key == "$and":
            for part in value:
                out = out & compile_where(part)
        elif isinstance(value, dict):
            for op, v in value.items():
                c = F.col(key)
                if op not in ("$in", "$lt", "$lte", "$eq"):
                    raise ValueError(f"unknown operator {op}")
                out = out & {"$in": lambda c, v: c.isin(list(v)), "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$eq": lambda c, v: c == v}[op](c, v)
        else:
            out = out & (F.col(key) == value)
    return out
