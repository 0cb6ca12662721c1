"""Idempotent upserts and entity resolution, as joins over whole tables.

Parquet has no merge; each operator returns the new table, to be written beside the old one and swapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerloom.functions import ids
from ledgerloom.operators.common import first_of, written

EDGE_KEY = ["subject_id", "predicate", "object_id", "period"]
FACT_KEY = ["company_id", "bsns_year", "fiscal_period", "fs_div", "metric_key"]


def latest_wins(current: DataFrame, batch: DataFrame, keys: list[str], order: list[Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """current with the batch's last row of each key in place of its own; columns in `keep` stay as they were first.

    order ranks a batch's rows, last first. Null keys are equal to each other.
    """
    newest = first_of(batch, keys, order)
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    fresh = F.col("n._new").isNotNull()
    joined = current.alias("o").join(newest.withColumn("_new", F.lit(1)).alias("n"), on, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return joined.select(*(pick(c).alias(c) for c in current.columns))


def upsert_nodes(nodes: DataFrame, batch: DataFrame, order: list[Column]) -> DataFrame:
    """Labels always change; attributes only if the batch has some. One join."""
    newest = first_of(batch, ["id"], order).select(F.col("id"), *(F.col(c).alias(f"_{c}") for c in nodes.columns if c != "id"), F.lit(True).alias("_new"))
    joined = nodes.join(newest, "id", "full_outer")
    pick = lambda c: F.coalesce(f"_{c}", c) if c == "attrs" else F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c))
    return joined.select("id", *(pick(c).alias(c) for c in nodes.columns if c != "id"))


def upsert_edges(edges: DataFrame, batch: DataFrame, order: list[Column]) -> DataFrame:
    return latest_wins(edges, batch, EDGE_KEY, order, keep=("extracted_at",))


def upsert_facts(facts: DataFrame, batch: DataFrame, order: list[Column]) -> DataFrame:
    """Only amounts change."""
    return latest_wins(facts, batch, FACT_KEY, order, keep=tuple(c for c in facts.columns if c not in (*FACT_KEY, "amount")))


def replace_exclusive(edges: DataFrame, batch: DataFrame, predicate: str) -> DataFrame:
    """At most one edge of a predicate for a subject: the batch's subjects lose their old ones."""
    old = edges.join(batch.select("subject_id").distinct().withColumn("predicate", F.lit(predicate)), ["subject_id", "predicate"], "left_anti")
    return old.select(*edges.columns).unionByName(batch.select(*edges.columns))


def repoint(edges: DataFrame, mapping: DataFrame, side: str, order: list[Column], buyer_raw: Column | None = None) -> DataFrame:
    """Edges with `side` (subject_id or object_id) replaced by mapping (old_id, new_id); of colliding edges the untouched, then the first, stays."""
    mapped = edges.join(mapping.select(F.col("old_id").alias(side), "new_id"), side, "left")
    moved = F.col("new_id").isNotNull()
    if buyer_raw is not None and "qualifier" in edges.columns:
        fields = edges.schema["qualifier"].dataType.fields
        said = F.coalesce("qualifier", F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields)))
        mapped = mapped.withColumn("qualifier", F.when(moved & buyer_raw.isNotNull(), said.withField("buyer_raw", buyer_raw)).otherwise(F.col("qualifier")))
    mapped = mapped.withColumn("_moved", moved.cast("int")).withColumn(side, F.coalesce("new_id", side)).drop("new_id")
    return first_of(mapped, EDGE_KEY, [F.col("_moved"), *order]).drop("_moved").select(*edges.columns)


def settled(mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mapping, cycles): old_id, new_id with each chain of aliases followed to its end, and the pairs whose chains have none.

    Pointer jumping: each round doubles the steps that every pair has taken, so a chain of n steps takes log2(n) rounds. A
    round after which as many pairs are open as before shows that the open ones lead into cycles: a chain with more steps to go has
    nodes at every shorter distance. These stay where they are. Each old_id once; pairs that lead to themselves are no moves.
    """
    given = written(mapping.select("old_id", "new_id").filter("old_id <> new_id"), "aliases")
    links, left = given, None
    while True:
        step = links.select(F.col("old_id").alias("new_id"), F.col("new_id").alias("_next"))
        jumped = links.join(step, "new_id", "left").select("old_id", F.coalesce("_next", "new_id").alias("new_id"), F.col("_next").isNotNull().alias("open"))
        jumped = written(jumped, "jumped")
        still = jumped.filter("open").count()
        if still in (0, left):
            done = jumped.filter("not open").select("old_id", "new_id")
            return done, given.join(jumped.filter("open").select("old_id"), "old_id", "left_semi")
        links, left = jumped.drop("open"), still


def drop_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    return nodes.join(mapping.select(F.col("old_id").alias("id")), "id", "left_anti")


def _to_company(nodes: DataFrame, who: DataFrame, alias: str, aliases: DataFrame, corp_norm: Column) -> DataFrame:
    """old_id, new_id of `who` (old_id, alias_norm, corp_norm): the company of the alias, else of the normalised name, if it exists."""
    companies = nodes.filter("kind = 'company' and not id like 'company:ext:%'")
    by_name = companies.select(corp_norm.alias("corp_norm"), "id").groupBy("corp_norm").agg(F.max("id").alias("by_name"))
    to_company = aliases.select(F.col("alias_norm").alias(alias), F.col("node_id").alias("by_alias"))
    found = who.join(to_company, alias, "left").join(by_name, "corp_norm", "left").select("old_id", F.coalesce("by_alias", "by_name").alias("new_id"))
    return found.join(companies.select(F.col("id").alias("new_id")), "new_id", "left_semi").select("old_id", "new_id")


def customer_mapping(nodes: DataFrame, aliases: DataFrame, alias_norm: Column, corp_norm: Column) -> DataFrame:
    """old_id, new_id of customers that are companies of the register: by alias, else by normalised name; an alias to a missing company does not fall back."""
    customers = nodes.filter("kind = 'customer'").select(F.col("id").alias("old_id"), alias_norm.alias("alias_norm"), corp_norm.alias("corp_norm"))
    return _to_company(nodes, customers, "alias_norm", aliases.filter("node_id like 'company:%'"), corp_norm)


def external_mapping(nodes: DataFrame, aliases: DataFrame, corp_norm: Column) -> DataFrame:
    """old_id, new_id of external companies that are companies of the register: by an alias of the normalised name, else by that name itself."""
    external = nodes.filter("kind = 'company' and id like 'company:ext:%'").select(F.col("id").alias("old_id"), corp_norm.alias("corp_norm"))
    return _to_company(nodes, external, "corp_norm", aliases.filter("node_id like 'company:%' and not node_id like 'company:ext:%'"), corp_norm)


def alias_mapping(
    nodes: DataFrame, aliases: DataFrame, kind: str, alias_norm: Column, target_prefix: str, source_prefix: str | None = None,
    barred_prefix: str | None = None
) -> DataFrame:
    """old_id, new_id of nodes of a kind whose alias leads to another existing node with a prefix."""
    sources = nodes.filter(F.col("kind") == kind)
    if source_prefix:
        sources = sources.filter(F.col("id").startswith(source_prefix))
    targets = aliases.filter(F.col("node_id").startswith(target_prefix))
    if barred_prefix:
        targets = targets.filter(~F.col("node_id").startswith(barred_prefix))
    found = sources.select(F.col("id").alias("old_id"), alias_norm.alias("alias_norm")).join(targets.select("alias_norm", F.col("node_id").alias("new_id")), "alias_norm")
    existing = nodes.filter(F.col("id").startswith(target_prefix)).select(F.col("id").alias("new_id"))
    return found.filter("old_id <> new_id").join(existing, "new_id", "left_semi").select("old_id", "new_id")


def seed_aliases(nodes: DataFrame, seeds: DataFrame, order: list[Column]) -> DataFrame:
    """alias_norm, node_id from seeds (node_id, variants, normalised by the caller); targets must exist, the last of equal aliases wins."""
    rows = seeds.select("*", F.explode("variants").alias("alias_norm")).join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return first_of(rows, ["alias_norm"], order).select("alias_norm", "node_id")


def renamespace(nodes: DataFrame, edges: DataFrame, aliases: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with global segments split by company: company A's edge to segment:x leads to segment:A:x instead.

    Segments that an alias leads to are shared on purpose and stay. Of edges that collide the one that was there stays, then the
    first by order. Global segments that no edge leads to any more go.
    """
    is_global = F.size(F.split("id", ":")) == 2
    split_up = nodes.filter((F.col("kind") == "segment") & is_global).join(aliases.select(F.col("node_id").alias("id")), "id", "left_anti")
    split_up = split_up.select(F.col("id").alias("object_id"), F.coalesce(F.col("attrs")["name"], F.col("label")).alias("_name"), F.col("label").alias("_label"))
    marked = edges.join(split_up, "object_id", "left")
    moves = (F.col("predicate") == "HAS_SEGMENT") & F.col("subject_id").startswith("company:") & F.col("_name").isNotNull()
    marked = marked.withColumn("_code", F.when(moves, F.substring("subject_id", len("company:") + 1, 1 << 20))).withColumn("_old", F.col("object_id"))
    marked = marked.withColumn("object_id", F.when(moves, ids.segment_id(F.col("_name"), F.col("_code"))).otherwise(F.col("object_id")))
    out = first_of(marked.withColumn("_moved", moves.cast("int")), EDGE_KEY, [F.col("_moved"), *order])
    attrs = F.create_map(F.lit("company"), F.col("_code"), F.lit("name"), F.col("_name"))
    created = marked.filter("_code is not null").select(F.col("object_id").alias("id"), F.lit("segment").alias("kind"), F.col("_label").alias("label"), attrs.alias("attrs"))
    created = first_of(created, ["id"], [F.col("label")]).join(nodes.select("id"), "id", "left_anti")
    used = out.select(F.col("object_id").alias("id")).distinct()
    gone = split_up.select(F.col("object_id").alias("id")).join(used, "id", "left_anti")
    return nodes.join(gone, "id", "left_anti").unionByName(created.select(*nodes.columns)), out.select(*edges.columns)


def canonical_owners(seeds: DataFrame) -> DataFrame:
    """Nodes (id, kind, label, attrs) of the owners in an alias seed (canonical): persons that stand for all spellings of one name."""
    rows = seeds.select(
        ids.canonical_person_id(F.col("canonical")).alias("id"), F.lit("person").alias("kind"), F.col("canonical").alias("label"),
        F.create_map(F.lit("canonical"), F.lit("true")).alias("attrs")
    )
    return first_of(rows, ["id"], [F.col("label")])


def mark_unresolved(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """nodes with attrs.resolved = false on customers that no mapping (old_id) leads away from."""
    left = nodes.join(mapping.select(F.col("old_id").alias("id"), F.lit(True).alias("_mapped")).distinct(), "id", "left")
    said = F.create_map(F.lit("resolved"), F.lit("false"))
    others = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, _: k != "resolved")
    unresolved = (F.col("kind") == "customer") & F.col("_mapped").isNull()
    return left.withColumn("attrs", F.when(unresolved, F.map_concat(others, said)).otherwise(F.col("attrs"))).select(*nodes.columns)
