"""Document trees against a document type: content models, required attributes, identifiers.

A type is declared as text in DTD syntax (ELEMENT and ATTLIST, parameter entities, INCLUDE and
IGNORE sections) and compiled on the driver to one regular expression per element over the tags of
its children; the check itself is joins and expressions over the node table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class DocumentType:
    models: dict[str, str] = field(default_factory=dict)
    mixed: set[str] = field(default_factory=set)
    required: dict[str, set[str]] = field(default_factory=dict)
    ids: set[tuple[str, str]] = field(default_factory=set)
    refs: set[tuple[str, str]] = field(default_factory=set)


def _expand(text: str, entities: dict[str, str], depth: int = 0) -> str:
    if depth > 40:
        raise ValueError("entities refer to each other")
    return re.sub(r"%([\w.:-]+);", lambda m: _expand(entities[m.group(1)], entities, depth + 1) if m.group(1) in entities else "", text)


def _declarations(text: str, entities: dict[str, str], folder: Path | None, out: list[str]) -> None:
    """Declarations in order; the first definition of an entity counts, files are read where they are referred to."""
    text, at = re.sub(r"<!--.*?-->", "", text, flags=re.S), 0
    token = re.compile(r"<!\[\s*([^\[\]]*?)\s*\[|<!(\w+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|%([\w.:-]+);|\]\]>", re.S)
    while match := token.search(text, at):
        at = match.end()
        if match.group(1) is not None:
            depth, end = 1, at
            while depth and (edge := re.compile(r"<!\[|\]\]>").search(text, end)):
                depth, end = depth + (1 if edge.group() == "<![" else -1), edge.end()
            if _expand(match.group(1), entities).strip() == "INCLUDE":
                _declarations(text[at : end - 3], entities, folder, out)
            at = end
        elif match.group(2) == "ENTITY":
            if found := re.match(r"\s*%\s+([\w.:-]+)\s+(?:PUBLIC\s+(?:\"[^\"]*\"|'[^']*')\s+|(SYSTEM)\s+)?(?:\"([^\"]*)\"|'([^']*)')", match.group(3), re.S):
                name, value = found.group(1), found.group(3) if found.group(3) is not None else found.group(4)
                outside = "PUBLIC" in match.group(3)[: found.start(3) if found.group(3) is not None else found.start(4)] or found.group(2)
                if name not in entities:
                    path = folder / value if outside and folder else None
                    entities[name] = f"\0{value}" if path and path.is_file() else "" if outside else value
        elif match.group(2):
            out.append(match.group(2) + " " + _expand(match.group(3), entities))
        elif match.group(4) in entities:
            value = entities[match.group(4)]
            inner = (folder / value[1:]).read_text(encoding="utf-8", errors="replace") if value[:1] == "\0" else value
            _declarations(inner, entities, folder, out)


def compile_type(text: str, folder: Path | None = None) -> DocumentType:
    """A document type from DTD text; external parts are read from `folder` where they are there."""
    made, found = DocumentType(), []
    _declarations(text, {}, folder, found)
    for declaration in found:
        kind, _, body = declaration.partition(" ")
        name, _, rest = body.strip().partition(" ") if kind == "ELEMENT" else body.strip().partition(" ")
        name, rest = re.match(r"([\w.:-]+)\s*(.*)", body.strip(), re.S).groups() if re.match(r"[\w.:-]+", body.strip()) else ("", "")
        if kind == "ELEMENT" and name and name not in made.models:
            model = rest.strip()
            if "#PCDATA" in model or model == "ANY":
                made.mixed.add(name)
            if model == "ANY":
                made.models[name] = ".*"
            elif model == "EMPTY":
                made.models[name] = ""
            else:
                flat = re.sub(r"\s+", "", model).replace("#PCDATA", "")
                flat = re.sub(r"\(\|", "(", re.sub(r"\|(?=[|)])", "", flat))
                made.models[name] = re.sub(r"[\w.:-]+", lambda m: f"(?:{re.escape(m.group())} )", flat).replace(",", "").replace("()*", "").replace("()", "")
        elif kind == "ATTLIST" and name:
            for attribute, sort, default in re.findall(r"([\w.:-]+)\s+(CDATA|ID|IDREFS?|NMTOKENS?|ENTITY|ENTITIES|NOTATION\s*\([^)]*\)|\([^)]*\))\s+(#REQUIRED|#IMPLIED|(?:#FIXED\s+)?(?:\"[^\"]*\"|'[^']*'))", rest):
                if default == "#REQUIRED":
                    made.required.setdefault(name, set()).add(attribute)
                if sort == "ID":
                    made.ids.add((name, attribute))
                if sort in ("IDREF", "IDREFS"):
                    made.refs.add((name, attribute))
    return made


def violations(nodes: DataFrame, kind: DocumentType) -> DataFrame:
    """(doc_id, node_id, tag, rule, detail): what the trees have that the type does not allow.

    Rules are unknown_element, content_model (detail: the children), text_not_allowed,
    missing_attribute, duplicate_id and unknown_idref. Children are gathered per parent; identifiers
    are compared within a document."""
    spark = nodes.sparkSession
    model = spark.createDataFrame([(k, f"^(?:{v})$", k in kind.mixed) for k, v in kind.models.items()], "tag string, model string, mixed boolean")
    elements = nodes.where("tag <> ''")
    children = elements.where("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tag"))), lambda x: F.concat(x["tag"], F.lit(" "))), "").alias("children"))
    known = elements.join(F.broadcast(model), "tag", "left").join(children, ["doc_id", "node_id"], "left").withColumn("children", F.coalesce("children", F.lit("")))
    out = known.where("model IS NULL").select("doc_id", "node_id", "tag", F.lit("unknown_element").alias("rule"), F.lit("").alias("detail"))
    out = out.unionByName(known.where("model IS NOT NULL").where(~F.expr("children rlike model")).select("doc_id", "node_id", "tag", F.lit("content_model").alias("rule"), F.trim("children").alias("detail")))
    out = out.unionByName(known.where("model IS NOT NULL AND NOT mixed AND trim(regexp_replace(coalesce(text, ''), '\\\\s', '')) <> ''").select("doc_id", "node_id", "tag", F.lit("text_not_allowed").alias("rule"), F.lit("").alias("detail")))
    if kind.required:
        needs = spark.createDataFrame([(t, a) for t, names in kind.required.items() for a in sorted(names)], "tag string, attribute string")
        lacking = elements.join(F.broadcast(needs), "tag").where(F.col("attrs")[F.col("attribute")].isNull())
        out = out.unionByName(lacking.select("doc_id", "node_id", "tag", F.lit("missing_attribute").alias("rule"), F.col("attribute").alias("detail")))
    pairs = lambda rows: spark.createDataFrame(sorted(rows), "tag string, attribute string")
    if kind.ids:
        ids = elements.join(F.broadcast(pairs(kind.ids)), "tag").select("doc_id", "node_id", "tag", F.col("attrs")[F.col("attribute")].alias("detail")).where("detail IS NOT NULL")
        twice = ids.groupBy("doc_id", "detail").agg(F.count("*").alias("n"), F.min("node_id").alias("first")).where("n > 1")
        out = out.unionByName(ids.join(twice, ["doc_id", "detail"]).where("node_id <> first").select("doc_id", "node_id", "tag", F.lit("duplicate_id").alias("rule"), "detail"))
        if kind.refs:
            refs = elements.join(F.broadcast(pairs(kind.refs)), "tag").select("doc_id", "node_id", "tag", F.explode(F.split(F.trim(F.col("attrs")[F.col("attribute")]), r"\s+")).alias("detail"))
            out = out.unionByName(refs.join(ids.select("doc_id", "detail").distinct(), ["doc_id", "detail"], "left_anti").select("doc_id", "node_id", "tag", F.lit("unknown_idref").alias("rule"), "detail"))
    return out


def resolve(path: str, base: str | Path) -> str:
    """An absolute path as it is; a relative one under `base` where it exists, else unchanged."""
    found = Path(base, path)
    return path if Path(path).is_absolute() or not found.exists() else str(found.resolve())
