"""Response trees: a pre-order walk of JSON text, and what is found in it."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from glosswright.functions import ids
from glosswright.session import ship

WALK = "pos int, depth int, parent int, path string, key string, type string, scalar string, fields map<string,string>, inner array<string>, filled boolean, value string"
#: Keys whose values are wanted as text besides.
TEXTS = ("node",)
#: Nodes of a batch.
NODES = 20_000


_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


def walk(text: str | None, texts: tuple[str, ...] = TEXTS) -> Iterator[tuple]:
    """``pos, depth, parent, path, key, type, scalar, fields, inner, filled, value`` of every node of a tree, in order; nothing for malformed text. No recursion.

    An object has the scalars below it in ``fields`` and the names of the objects and arrays below it in ``inner``, so that what is found in an object needs no text of it;
    ``value`` is the text of objects and arrays under ``texts`` alone. Null, an empty text, object or array aren't ``filled``.
    """
    try:
        root = json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return
    todo, pos = [(root, 0, -1, "$", None)], 0
    while todo:
        node, depth, parent, path, key = todo.pop()
        kind = _KINDS[type(node)]
        scalar = fields = inner = value = None
        if kind == "object":
            fields, inner, below = [], [], []
            for k, v in node.items():
                if isinstance(v, (dict, list)):
                    inner.append(k)
                elif v is not None:
                    fields.append((k, v if isinstance(v, str) else json.dumps(v)))
                below.append((v, depth + 1, pos, f"{path}.{k}", k))
            todo += below[::-1]
        elif kind == "array":
            todo += [(v, depth + 1, pos, f"{path}[{i}]", None) for i, v in enumerate(node)][::-1]
        elif node is not None:
            scalar = node if kind == "string" else json.dumps(node)
        if key in texts and kind in ("object", "array"):
            value = json.dumps(node, ensure_ascii=False)
        yield pos, depth, parent, path, key, kind, scalar, fields, inner, node is not None and node not in ("", [], {}), value
        pos += 1


def walked(df: DataFrame, keys: list[str], text: str = "line", texts: tuple[str, ...] = TEXTS) -> DataFrame:
    """The walk of each row's JSON text, with the row's ``keys``. A row's tree stays in one task; nothing is shuffled."""
    ship(df.sparkSession)
    df = df.select(*keys, F.col(text).alias("text_"))
    kinds = StructType([*df.drop("text_").schema, *StructType.fromDDL(WALK)])
    schema = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = schema.names[: len(keys)]
        for batch in batches:
            rows, of = [], []

            def made(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                columns = zip(*rows) if rows else [[]] * (len(schema) - len(own))
                return pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(of, pa.int32())) for i in range(len(own))] + [pa.array(x, t.type) for x, t in zip(columns, list(schema)[len(own) :])], schema=schema)

            for i, line in enumerate(batch.column(len(own)).to_pylist()):
                for node in walk(line, texts):
                    rows.append(node)
                    of.append(i)
                    if len(rows) >= NODES:
                        yield made()
                        rows, of = [], []
            if rows:
                yield made()

    return df.mapInArrow(run, kinds)


def _field(name: str) -> Column:
    return F.try_element_at("fields", F.lit(name))


def _first(where: Column, value: Column) -> Column:
    """An aggregate: the value of the first node that meets a condition."""
    return F.min_by(F.when(where, value), F.when(where, F.col("pos")))


def _filled(key: str) -> tuple[Column, Column]:
    return (F.col("key") == key) & F.col("filled"), F.coalesce("scalar", "value")


def first_value(tree: DataFrame, keys: list[str], key: str) -> DataFrame:
    """The first filled value of ``key`` of each tree; of objects and arrays only where their text was wanted."""
    where, value = _filled(key)
    return tree.where(where).groupBy(*keys).agg(F.min_by(value, "pos").alias(key))


def _node() -> Column:
    return (F.col("key") == "node") & (F.col("type") == "object")


def _names_post(bare: bool) -> Column:
    """Whether a node names a post: nodes with ``comet_sections``, and with ``bare`` every number under ``post_id``."""
    sections = F.array_contains("inner", "comet_sections") | _field("comet_sections").isNotNull()
    return (_node() & sections & (_field("id") != "")) | (F.lit(bare) & (F.col("key") == "post_id") & F.col("scalar").rlike(r"^\d+$"))


def _post() -> Column:
    return F.when(_node(), _field("id")).otherwise(F.col("scalar"))


def post_ids(tree: DataFrame, keys: list[str], bare: bool = True) -> DataFrame:
    """Distinct ids of posts: of nodes with ``comet_sections``, and with ``bare`` every number under ``post_id``; ``first_pos`` orders them."""
    return tree.where(_names_post(bare)).groupBy(*keys, _post().alias("post_id")).agg(F.min("pos").alias("first_pos"))


def post_nodes(tree: DataFrame, keys: list[str]) -> DataFrame:
    """The first node of each id: ``post_id, node`` (JSON), an equi-join key for ``post_ids``."""
    node = tree.where(_node() & F.col("filled") & _field("id").isNotNull())
    return node.groupBy(*keys, _field("id").alias("post_id")).agg(F.min_by("value", "pos").alias("node"))


def posts(tree: DataFrame, keys: list[str], bare: bool = True) -> DataFrame:
    """``post_ids`` with the ``post_nodes`` of the same tree, in one pass."""
    names, node = _names_post(bare), _node() & F.col("filled") & _field("id").isNotNull()
    found = tree.where(names | node).groupBy(*keys, _post().alias("post_id")).agg(F.min(F.when(names, F.col("pos"))).alias("first_pos"), _first(node, F.col("value")).alias("node"))
    return found.where("first_pos IS NOT NULL")


def tree_facts(tree: DataFrame, keys: list[str], values: tuple[str, ...] = (), bare: bool = True) -> DataFrame:
    """Of each tree in one pass: ``n`` nodes, the first filled ``cursor``, the ``ids`` of posts in order, ``nodes`` (``post_id, node``) of its posts, and the first filled value of each of ``values``."""
    names, node = _names_post(bare), _node() & F.col("filled") & _field("id").isNotNull()
    cursor = (F.col("key") == "page_info") & (_field("end_cursor") != "")
    # What is aggregated is told node by node before: whole nodes would be sorted and spilled.
    at = lambda where, value: F.when(where, F.struct("pos", value.alias("v")))
    rows = tree.select(*keys, at(cursor, _field("end_cursor")).alias("cursor_"), at(names, _post()).alias("id_"), F.when(node, F.struct("pos", _field("id").alias("post_id"), F.col("value").alias("node"))).alias("node_"), *[at(*_filled(k)).alias(f"value_{i}") for i, k in enumerate(values)])
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("cursor_")["v"].alias("cursor"),
        F.array_distinct(F.transform(F.sort_array(F.collect_list("id_")), lambda x: x["v"])).alias("ids"),
        F.sort_array(F.collect_list("node_")).alias("nodes"),
        *[F.min(f"value_{i}")["v"].alias(k) for i, k in enumerate(values)],
    )
    return out.withColumn("nodes", F.transform("nodes", lambda x: F.struct(x["post_id"].alias("post_id"), x["node"].alias("node"))))


def end_cursors(tree: DataFrame, response: list[str], line: str = "line_no") -> DataFrame:
    """Of each response the first filled ``page_info.end_cursor`` of its last line that has one."""
    found = tree.where((F.col("key") == "page_info") & (F.col("type") == "object") & (_field("end_cursor") != ""))
    return found.groupBy(*response).agg(F.min_by(_field("end_cursor"), F.struct(-F.col(line), F.col("pos"))).alias("cursor"))


def caption(node: Column) -> Column:
    return F.coalesce(F.get_json_object(node, "$.comet_sections.content.story.message.text"), F.lit(""))


#: Where a post's pictures are.
ATTACHMENTS = "$.comet_sections.content.story.attachments"


def _picture(require_height: bool, least_width: int) -> Column:
    uri = _field("uri")
    found = F.startswith("path", F.lit(ATTACHMENTS)) & (F.contains(uri, F.lit("scontent")) | F.contains(uri, F.lit("fbcdn"))) & (F.contains(uri, F.lit("jpg")) | F.contains(uri, F.lit(".png")))
    found = found & (_field("width").try_cast("double") > least_width)
    return found & _field("height").isNotNull() if require_height else found


def _addresses(where: Column) -> Column:
    """An aggregate: the distinct addresses in their order; as many as one tree has."""
    return F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(where, F.struct(F.col("pos"), _field("uri").alias("uri"))))), lambda x: x["uri"]))


def images(tree: DataFrame, keys: list[str], require_height: bool = True, least_width: int = 400) -> DataFrame:
    """The distinct picture addresses under attachments of each tree of a node, wider than ``least_width``."""
    where = _picture(require_height, least_width)
    return tree.where(where).groupBy(*keys).agg(_addresses(where).alias("image_urls"))


def _is_actor() -> Column:
    return _field("__typename").isin("User", "Page") & (_field("id") != "") & (_field("name") != "")


def _actor() -> Column:
    return F.struct(_field("id").alias("author_id"), _field("name").alias("author_name"))


def actors(tree: DataFrame, keys: list[str]) -> DataFrame:
    """The first user or page with id and name of each tree: ``author_id, author_name``."""
    return tree.where(_is_actor()).groupBy(*keys).agg(F.min_by(_actor(), "pos").alias("a")).select(*keys, "a.*")


def post_facts(tree: DataFrame, keys: list[str], post_id: str, group: str, require_height: bool = True) -> DataFrame:
    """Author, address, time and pictures of each node's tree (``keys`` hold the column ``post_id``), in one pass."""
    from glosswright.functions.text import iso_time

    values = {k: _first(*_filled(k)).alias(k) for k in ("creation_time", "wwwURL", "url")}
    base = tree.groupBy(*keys).agg(_first(_is_actor(), _actor()).alias("a"), *values.values(), _addresses(_picture(require_height, 400)).alias("image_urls"))
    base = base.withColumn("decoded", ids.decode_id(F.col(post_id)))
    epoch = F.col("creation_time").try_cast("double")
    author = F.coalesce("a.author_id", "decoded.author")
    return base.select(
        *keys,
        F.lit(group).alias("group_id"),
        F.col("decoded.post").alias("post_id_numeric"),
        author.alias("author_id"),
        F.col("a.author_name").alias("author_name"),
        ids.chosen_url(F.col("wwwURL"), F.col("url"), group, F.col("decoded.post")).alias("post_url"),
        ids.author_url(author).alias("author_url"),
        epoch.alias("creation_time_epoch"),
        iso_time(epoch).alias("publish_time"),
        "image_urls",
    )
