"""Answers of outside sources as rows: JSON of unknown shape, or plain text, to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.plans import bindings as b
from glyphmill.plans.registry import query

#: Keys that hold the list of an answer, and names of a document's fields, in the order in which they are tried.
CONTAINERS = ("items", "results", "data", "documents", "docs", "issues", "merge_requests", "nodes", "sections", "hits", "matches")
ALIASES = {
    "id": ("id", "iid", "doc_id", "key", "number"), "title": ("title", "name", "summary", "heading", "doc_name"), "url": ("url", "web_url", "html_url", "link", "permalink"),
    "collection": ("collection", "project", "list", "repository", "namespace"), "content": ("content", "description", "body", "text", "snippet", "excerpt"),
}
#: Fixed value: bound on a document's content.
MOST_CONTENT = 4000

_MAP, _MAPS = "map<string,string>", "array<map<string,string>>"


def _field(item: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.nullif(F.element_at(item, F.lit(n)), F.lit("")) for n in names], F.lit(""))


def _sections(item: Column) -> Column:
    """Contents of an item's sections, those that aren't empty, with a blank line between."""
    each = F.from_json(F.element_at(item, F.lit("sections")), _MAPS)
    texts = F.transform(each, lambda x: F.coalesce(F.element_at(x, F.lit("content")), F.lit("")))
    return F.coalesce(F.array_join(F.filter(texts, lambda x: x != ""), "\n\n"), F.lit(""))


def documents_of(answers: DataFrame, payload: str, most: int = MOST_CONTENT) -> DataFrame:
    """answers' other columns with (pos, id, title, url, collection, content): a list, a list within an object, one object, or else the text itself.

    Empty answers give no rows; an item without title, content and url gives none. Values of other kinds than text count as their JSON.
    """
    keys = [c for c in answers.columns if c != payload]
    text = F.trim(F.col(payload))
    whole = F.when(F.startswith(text, F.lit("{")), F.from_json(text, _MAP))
    lists = [F.from_json(F.element_at(F.col("_whole"), F.lit(k)), _MAPS) for k in CONTAINERS]
    # one object isn't a list of itself, though a bad list could be read so
    held = F.coalesce(*[F.when(F.startswith(F.element_at(F.col("_whole"), F.lit(k)), F.lit("[")) & (F.size(x) > 0) & F.forall(x, lambda m: m.isNotNull()), x) for k, x in zip(CONTAINERS, lists, strict=True)])
    rows = answers.withColumns({"_text": text, "_whole": whole}).where("_text <> ''")
    items = F.when(F.startswith("_text", F.lit("[")), F.from_json("_text", _MAPS)).when(F.col("_whole").isNotNull(), F.coalesce(held, F.array("_whole")))
    items = F.coalesce(items, F.array(F.create_map(F.lit("content"), F.col("_text"))))
    out = rows.select(*keys, F.posexplode(items).alias("pos", "_item"))
    item = F.col("_item")
    full = F.coalesce(F.get_json_object(F.element_at(item, F.lit("references")), "$.full"), F.lit(""))
    fields = {k: _field(item, names) for k, names in ALIASES.items()}
    fields["collection"] = F.when(fields["collection"] == "", full).otherwise(fields["collection"])
    fields["content"] = F.substring(F.when(fields["content"] == "", _sections(item)).otherwise(fields["content"]), 1, most)
    out = out.select(*keys, "pos", *[c.alias(k) for k, c in fields.items()])
    return out.where("title <> '' or content <> '' or url <> ''")


@query("scan_payload_documents", """WITH f AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, trim(coalesce(text, ''), ' ') AS text FROM documents)
SELECT doc_id, 0 AS pos, CASE WHEN doc_id % 5 = 4 THEN '' ELSE doc_id::VARCHAR END AS id, CASE doc_id % 5 WHEN 4 THEN '' WHEN 3 THEN '' ELSE lang END AS title, CASE WHEN doc_id % 5 = 1 THEN 'u/' || doc_id ELSE '' END AS url,
  CASE doc_id % 5 WHEN 0 THEN source WHEN 1 THEN source WHEN 2 THEN 'g/' || source ELSE '' END AS collection, left(CASE WHEN doc_id % 5 = 3 THEN text || chr(10) || chr(10) || lang ELSE text END, 4000) AS content FROM f WHERE text <> ''
UNION ALL SELECT doc_id, 1, 'x', 'second', '', '', '' FROM f WHERE doc_id % 5 = 1 AND text <> ''""")
def payload_documents(s, d):
    """Documents wrapped as five shapes of answers, and read back."""
    body = F.trim(F.coalesce("text", F.lit("")))
    f = b.table(s, d, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), body.alias("text")).where("text <> ''")
    key = F.col("doc_id").cast("string")
    flat = F.struct(F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.col("source").alias("collection"), F.col("text").alias("content"))
    linked = F.to_json(F.struct(key.alias("iid"), F.col("lang").alias("name"), F.concat(F.lit("u/"), key).alias("web_url"), F.col("source").alias("project"), F.col("text").alias("description")))
    empty, second = F.to_json(F.struct(F.lit("y").alias("id"))), F.to_json(F.struct(F.lit("x").alias("id"), F.lit("second").alias("title")))
    full = F.struct(F.col("doc_id").alias("key"), F.col("lang").alias("heading"), F.struct(F.concat(F.lit("g/"), "source").alias("full")).alias("references"), F.col("text").alias("body"))
    parts = F.array(F.struct(F.col("text").alias("content")), F.struct(F.lit("").alias("content")), F.struct(F.col("lang").alias("content")))
    nested = F.struct(F.array(F.struct(key.alias("doc_id"), parts.alias("sections"))).alias("results"))
    shape = (
        F.when(F.col("doc_id") % 5 == 0, F.to_json(F.array(flat))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit('{"total": 3, "items": ['), linked, F.lit(","), second, F.lit(","), empty, F.lit("]}")))
        .when(F.col("doc_id") % 5 == 2, F.to_json(full)).when(F.col("doc_id") % 5 == 3, F.to_json(nested)).otherwise(F.col("text"))
    )
    return documents_of(f.select("doc_id", shape.alias("payload")), "payload")
