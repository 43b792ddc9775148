"""Deeply nested manifests turned into related flat tables.

A bottom-up tree automaton gives every node a state: members are ``record`` or ``text``,
containers are ``list``, ``named`` (an object of objects), ``single`` (one object where a
list is usual), ``null`` or ``absent``, and the state of a cluster follows from those of its
parts. Every state goes to its own typed subtype table; the flat tables hold the columns
all subtypes share, with the keys of the parents. Everything is a variant expression, so
a document is parsed once and exploded inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.session import cut

#: Fields by which an object is known to be a cluster, burst group or member itself.
CLUSTER_FIELDS = ("cluster_id", "members", "member_filenames", "representative_filename", "burst_group_ids", "member_count")
BURST_FIELDS = ("burst_group_id", "member_filenames", "representative_filename", "member_count")
MEMBER_FIELDS = ("filename", "relative_path", "burst_group_id", "captured_at", "blur_score")

_LIST, _MAP = "array<variant>", "map<string,variant>"


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.capitalize() for x in rest)


def field(node: Column, name: str, kind: str = "variant") -> Column:
    """A field of an object under its snake_case or camelCase name; null if missing or JSON null."""
    get = lambda n: F.try_variant_get(node, f"$.{n}", kind)
    if kind == "variant":
        present = lambda c: F.when(~F.is_variant_null(c), c)
        return F.coalesce(present(get(name)), present(get(_camel(name))))
    return F.coalesce(get(name), get(_camel(name)))


def whole_document(text: Column) -> Column:
    """The text as a variant if it is exactly one JSON document, else null.

    Allowed around it are blanks, a byte-order mark before it, and a JSON string that holds
    it. The parser stops at the end of a first value, hence the text is parsed inside an
    array and inside an object: either wrapping fails on a cut or trailing text.
    """

    def parse(t: Column) -> Column:
        bare = F.regexp_replace(t, "^\\s*\\uFEFF", "")
        listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), bare, F.lit("]"))), "$", _LIST)
        boxed = F.try_parse_json(F.concat(F.lit('{"x":'), bare, F.lit("}")))
        return F.when((F.size(listed) == 1) & boxed.isNotNull(), F.get(listed, F.lit(0)))

    outer = parse(text)
    kind = F.schema_of_variant(outer)
    return F.when(kind == "STRING", parse(outer.cast("string"))).otherwise(outer)


def _is_object(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node).startswith("OBJECT"), F.lit(False))


def _has_any(node: Column, names: tuple[str, ...]) -> Column:
    keys = F.map_keys(F.try_variant_get(node, "$", _MAP))
    return F.coalesce(F.arrays_overlap(keys, F.array(*[F.lit(x) for n in names for x in (n, _camel(n))])), F.lit(False))


def container_state(node: Column, own_fields: tuple[str, ...]) -> Column:
    """State of a container: absent, null, list, single, named or text."""
    kind = F.schema_of_variant(node)
    return (
        F.when(node.isNull(), "absent")
        .when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "list")
        .when(kind.startswith("OBJECT"), F.when(_has_any(node, own_fields), "single").otherwise("named"))
        .otherwise("text")
    )


def entries(node: Column, own_fields: tuple[str, ...]) -> Column:
    """The entries of a container of any state as array<struct<pos, name, node>>."""
    entry = lambda pos, name, item: F.struct(pos.cast("int").alias("pos"), name.cast("string").alias("name"), item.alias("node"))
    listed = F.transform(F.try_variant_get(node, "$", _LIST), lambda x, i: entry(i, F.lit(None), x))
    named = F.transform(F.map_entries(F.try_variant_get(node, "$", _MAP)), lambda e, i: entry(i, e["key"], e["value"]))
    alone = F.array(entry(F.lit(0), F.lit(None), node))
    state = container_state(node, own_fields)
    return F.when(state == "list", listed).when(state == "named", named).when(state.isin("single", "text"), alone)


def _names(node: Column) -> Column:
    """The texts of a list of names, of the values of an object, or of one text."""
    kind = F.schema_of_variant(node)
    text = lambda x: F.try_variant_get(x, "$", "string")
    listed = F.transform(F.try_variant_get(node, "$", _LIST), text)
    values = F.transform(F.map_values(F.try_variant_get(node, "$", _MAP)), text)
    return F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), values).when(kind != "VOID", F.array(text(node)))


def latest_documents(deliveries: DataFrame) -> DataFrame:
    """(manifest_id, trip_id, day_name, received_at, doc): the document of each manifest's latest delivery.

    Of equal received_at the greatest payload counts; a null received_at comes before all
    others. A manifest whose latest payload is null or not one whole JSON object is left out.
    """
    rows = deliveries.where("manifest_id is not null").select("manifest_id", F.struct("received_at", "payload", "trip_id", "day_name").alias("row"))
    last = rows.groupBy("manifest_id").agg(F.max("row").alias("row")).select("manifest_id", "row.*")
    return last.withColumn("doc", whole_document(F.col("payload"))).where(_is_object(F.col("doc"))).drop("payload")


def manifest_table(docs: DataFrame) -> DataFrame:
    """One row for each manifest: its key, declared counts and the states of its containers."""
    doc = F.col("doc")
    count = lambda n: field(field(doc, "summary"), n, "bigint").alias(f"declared_{n}")
    return docs.select(
        "manifest_id", "trip_id", F.coalesce(field(doc, "day_name", "string"), "day_name").alias("day_name"), field(doc, "manifest_version", "int").alias("manifest_version"),
        count("accepted_photo_count"), count("burst_group_count"), count("cluster_count"), count("singleton_cluster_count"),
        container_state(field(doc, "clusters"), CLUSTER_FIELDS).alias("clusters_state"), container_state(field(doc, "burst_groups"), BURST_FIELDS).alias("bursts_state"),
    )


def burst_table(docs: DataFrame) -> DataFrame:
    """(manifest_id, burst_pos, burst_group_id, representative_filename, member_count, filenames)."""
    exploded = docs.select("manifest_id", F.explode(entries(field(F.col("doc"), "burst_groups"), BURST_FIELDS)).alias("e")).select("manifest_id", "e.*")
    node = F.col("node")
    return exploded.select(
        "manifest_id", F.col("pos").alias("burst_pos"), F.coalesce(field(node, "burst_group_id", "string"), "name").alias("burst_group_id"),
        field(node, "representative_filename", "string").alias("representative_filename"), field(node, "member_count", "bigint").alias("member_count"), _names(field(node, "member_filenames")).alias("filenames"),
    )


def _cluster_nodes(docs: DataFrame) -> DataFrame:
    exploded = docs.select("manifest_id", F.explode(entries(field(F.col("doc"), "clusters"), CLUSTER_FIELDS)).alias("e")).select("manifest_id", "e.*")
    node = F.col("node")
    return exploded.where(_is_object(node)).select(
        "manifest_id", F.col("pos").alias("cluster_pos"), F.coalesce(field(node, "cluster_id", "string"), "name").alias("cluster_id"),
        F.col("name").isNotNull().alias("by_name"), "node", field(node, "members").alias("members"),
    )


def cluster_table(docs: DataFrame) -> DataFrame:
    """One row for each cluster with its parent's key; ``variant`` is the automaton's state of the object."""
    node = F.col("node")
    below = container_state(F.col("members"), MEMBER_FIELDS)
    variant = F.concat(F.when(F.col("by_name"), "named").otherwise("own"), F.lit("/"), F.when(below == "absent", F.when(field(node, "member_filenames").isNull(), "empty").otherwise("names")).otherwise(below))
    return _cluster_nodes(docs).select(
        "manifest_id", "cluster_pos", "cluster_id", variant.alias("variant"), field(node, "representative_filename", "string").alias("representative_filename"),
        field(node, "member_count", "bigint").alias("member_count"), _names(field(node, "burst_group_ids")).alias("burst_group_ids"),
    )


def member_table(docs: DataFrame) -> DataFrame:
    """One row for each member of each cluster, with the parents' keys and ``variant`` record or text.

    Members come from ``members`` or, where that is missing or null, from ``member_filenames``.
    Members without a filename are left out. Without a burst of its own a member has that
    of the first entry of burst_groups that lists its filename, else an empty string.
    """
    nodes = _cluster_nodes(docs)
    listed = F.transform(_names(field(F.col("node"), "member_filenames")), lambda x, i: F.struct(i.cast("int").alias("pos"), x.alias("name"), F.lit(None).cast("variant").alias("node")))
    exploded = nodes.select("manifest_id", "cluster_pos", "cluster_id", F.explode(F.when(F.col("members").isNull(), listed).otherwise(entries(F.col("members"), MEMBER_FIELDS))).alias("m"))
    node = F.col("m.node")
    record = _is_object(node)
    text = F.when(~record, F.try_variant_get(node, "$", "string"))
    filename = F.coalesce(F.when(record, field(node, "filename", "string")), text, F.col("m.name"))
    value = lambda n, t: F.when(record, field(node, n, t)).alias(n)
    members = exploded.select(
        "manifest_id", "cluster_pos", "cluster_id", F.col("m.pos").alias("member_pos"), filename.alias("filename"), F.when(record, "record").otherwise("text").alias("variant"), value("burst_group_id", "string").alias("own_burst"),
        value("relative_path", "string"), value("captured_at", "string"), value("orientation", "string"), value("blur_score", "double"), value("brightness_mean", "double"), value("overexposed_ratio", "double"),
        value("cosine_distance_to_representative", "double"), value("histogram_similarity_to_representative", "double"), value("perceptual_hash_distance_to_representative", "int"), value("category_name", "string"),
    ).where("filename is not null")
    bursts = burst_table(docs).where("burst_group_id is not null").select("manifest_id", "burst_pos", "burst_group_id", F.explode("filenames").alias("filename"))
    first = bursts.where("filename is not null").groupBy("manifest_id", "filename").agg(F.min_by("burst_group_id", "burst_pos").alias("listed_burst"))
    return members.join(first, ["manifest_id", "filename"], "left").withColumn("burst_group_id", F.coalesce("own_burst", "listed_burst", F.lit(""))).drop("own_burst", "listed_burst")


def flatten_manifests(deliveries: DataFrame) -> dict[str, DataFrame]:
    """The related tables manifests, bursts, clusters and members; children hold manifest_id and cluster_pos of their parents.

    Empty input gives empty tables. Repeated and outdated deliveries, unreadable payloads,
    other columns of ``deliveries`` and unknown fields of a document change nothing.
    """
    docs = latest_documents(deliveries)
    return {"manifests": manifest_table(docs), "bursts": burst_table(docs), "clusters": cluster_table(docs), "members": member_table(docs)}


def subtype_tables(flat: DataFrame, variants: list[str], shared: list[str]) -> dict[str, DataFrame]:
    """A typed table for each of the variants, reduced to the columns that variant fills, with the shared keys."""
    only = {"text": ["filename", "member_pos"]}
    return {v: flat.where(F.col("variant") == v).select(*shared, *[c for c in flat.columns if c not in {*shared, "variant"} and (v not in only or c in only[v])]) for v in variants}


def manifest_cases(deliveries: DataFrame) -> DataFrame:
    """(manifest_id, cluster_id, burst_group_id, filename): each distinct filename of each cluster once.

    The same members as in ``member_table``: clusters and burst groups of a document are
    exploded together, so it is parsed once, every entry gets its state once and goes to the
    typed subtype table of that state, and the union of those over the shared keys is
    shuffled once by file, which brings members and listings to each other. If one cluster
    lists a filename several times, its first entry counts, or without a listing its first
    entry with a burst.
    """
    docs = latest_documents(deliveries)
    tagged = lambda name, own, kind: F.coalesce(F.transform(entries(field(F.col("doc"), name), own), lambda e: F.struct(F.lit(kind).alias("kind"), e["pos"].alias("pos"), e["name"].alias("name"), e["node"].alias("node"))), F.array().cast("array<struct<kind:string,pos:int,name:string,node:variant>>"))
    groups = docs.select("manifest_id", F.explode(F.concat(tagged("clusters", CLUSTER_FIELDS, "c"), tagged("burst_groups", BURST_FIELDS, "b"))).alias("e")).select("manifest_id", "e.*")
    node, cluster = F.col("node"), F.col("kind") == "c"
    read = groups.where((F.col("kind") == "b") | _is_object(node)).select(
        "manifest_id", "kind", "pos", F.coalesce(F.when(cluster, field(node, "cluster_id", "string")).otherwise(field(node, "burst_group_id", "string")), "name").alias("id"),
        F.when(cluster, field(node, "members")).alias("members"), field(node, "member_filenames").alias("names"),
    )
    listed = F.transform(_names(F.col("names")), lambda x, i: F.struct(i.cast("int").alias("pos"), x.alias("name"), F.lit(None).cast("variant").alias("node")))
    items = read.select("manifest_id", "kind", "pos", "id", F.explode(F.when(F.col("members").isNull(), listed).otherwise(entries(F.col("members"), MEMBER_FIELDS))).alias("m"))
    own_node = F.col("m.node")
    record = _is_object(own_node)
    filename = F.coalesce(F.when(record, field(own_node, "filename", "string")), F.when(~record, F.try_variant_get(own_node, "$", "string")), F.col("m.name"))
    shared = ["manifest_id", "kind", "pos", "id", "member_pos"]
    flat = cut(items.select("manifest_id", "kind", "pos", "id", F.col("m.pos").alias("member_pos"), filename.alias("filename"), F.when(record, "record").otherwise("text").alias("variant"), F.when(record, field(own_node, "burst_group_id", "string")).alias("own")).where("filename is not null"))
    parts = subtype_tables(flat, ["record", "text"], shared)
    files = parts["record"].unionByName(parts["text"], allowMissingColumns=True).withColumnRenamed("member_pos", "at")  # a text has no burst of its own
    near = files.repartition("manifest_id", "filename")
    is_burst, told = F.col("kind") == "b", F.coalesce(F.col("own"), F.lit("")) != ""
    cases = near.groupBy("manifest_id", "filename", "kind", F.when(~is_burst, F.col("id")).alias("cluster_id")).agg(
        F.min_by("own", "at").alias("first_own"), F.min_by("own", F.when(told, F.col("at"))).alias("some_own"), F.min_by("id", F.when(is_burst & F.col("id").isNotNull(), F.col("pos"))).alias("listed")
    )
    burst = F.max(F.when(is_burst, F.col("listed"))).over(Window.partitionBy("manifest_id", "filename"))
    found = cases.withColumn("__listed", burst).where("kind = 'c'")
    return found.select("manifest_id", "cluster_id", F.when(F.col("__listed").isNotNull(), F.coalesce("first_own", "__listed")).otherwise(F.coalesce("some_own", F.lit(""))).alias("burst_group_id"), "filename")
