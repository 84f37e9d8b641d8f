"""Delete with foreign-key rules (W4), as set operations over whole tables.

Given a DataFrame of keys to delete from one table:

* RESTRICT / NO ACTION: keys still referenced by a blocking child are rejected (``left_semi`` against
  the child, one pass per blocking edge). The schema guarantees blocking edges only start at tables no
  cascade can reach (``schema.check_graph_invariants``), so deciding at the root key is exact.
* CASCADE: walk the cascade edges in topological order; each reached table loses the rows whose foreign
  key hits a deleted parent key (``left_anti``, one per incoming edge, so a table reached by two paths,
  like guardianship, applies both).
* SET NULL: surviving child rows pointing at a deleted key get the column set to NULL (left join against
  the distinct deleted keys).

Deleted key sets are usually far smaller than the tables they filter; AQE broadcasts them at runtime
when they are, and shuffles otherwise. Each key set is pinned once with a reliable checkpoint, because
every touched table reads it, and the lineage is cut there. No step collects keys on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roster import schema
from roster.plans.partitions import hashed, spread
from roster.session import ensure_checkpoint_dir
from roster.sources.tables import Tables


@dataclass
class DeleteResult:
    tables: Tables                 # new version of all tables
    touched: list[str]             # tables the delete may change
    deleted: DataFrame             # accepted root keys
    rejected: DataFrame            # root keys refused, with the first blocking child table
    set_null: list[schema.ForeignKey]

    @property
    def changed(self) -> dict[str, DataFrame]:
        """The new frames of the touched tables."""
        return {name: self.tables.get(name) for name in self.touched}


def _key_of(fk: schema.ForeignKey) -> str:
    return fk.parent_column


def _pin(df: DataFrame, materialize: bool) -> DataFrame:
    """Write a deleted-key set once (reliable checkpoint in the session's checkpoint folder): every
    table of the delete reads it, so the parent scan and its joins are not repeated per table."""
    if not materialize:
        return df
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_cascade(t: Tables, root: str, keys: DataFrame, materialize: bool = True) -> DeleteResult:
    schema.check_graph_invariants()
    spec = schema.table(root)
    pk = list(spec.primary_key)
    # Only rows that exist can be deleted; unknown keys are ignored, as a DELETE ... WHERE would.
    targets = t.get(root, *pk).join(keys.select(*pk), pk, "left_semi")

    rejected_parts = []
    remaining = targets
    for fk in schema.children_of(root):
        if fk.on_delete not in schema.BLOCKING:
            continue
        refs = t.get(fk.child, fk.column).select(F.col(fk.column).alias(_key_of(fk)))
        hit = remaining.join(refs, _key_of(fk), "left_semi")
        rejected_parts.append(hit.withColumn("blocked_by", F.lit(fk.child)))
        remaining = remaining.join(refs, _key_of(fk), "left_anti")
    accepted = _pin(remaining, materialize)
    rejected = (reduce(DataFrame.unionByName, rejected_parts) if rejected_parts
                else targets.limit(0).withColumn("blocked_by", F.lit(None).cast("string")))

    deleted_keys: dict[str, DataFrame] = {root: accepted}
    edges: dict[str, list[schema.ForeignKey]] = {}
    closure = schema.cascade_closure(root)
    for name in closure[1:]:
        edges[name] = incoming = [fk for fk in schema.parents_of(name)
                                  if fk.on_delete == schema.CASCADE and fk.parent in deleted_keys]
        # Keys of this table are needed only when they propagate further (cascade or set-null children).
        if any(c.on_delete in (schema.CASCADE, schema.SET_NULL) for c in schema.children_of(name)):
            tpk = list(schema.table(name).primary_key)
            parts = [t.get(name, *dict.fromkeys([*tpk, fk.column])).join(
                        hashed(deleted_keys[fk.parent].select(F.col(_key_of(fk)).alias(fk.column)), t.tasks(name)), fk.column, "left_semi")
                     .select(*tpk) for fk in incoming]
            deleted_keys[name] = _pin(reduce(DataFrame.unionByName, parts), materialize)

    nulled = [fk for parent in deleted_keys for fk in schema.children_of(parent) if fk.on_delete == schema.SET_NULL]

    def survivors(name: str):
        """Builds the changed table from the columns asked for and those the rules need, so that nothing else is made."""
        drop = edges.get(name, [])
        clear = [fk for fk in nulled if fk.child == name]

        def build(cols: tuple[str, ...] | None) -> DataFrame:
            wanted = list(cols or schema.table(name).columns)
            needed = dict.fromkeys([*wanted, *(pk if name == root else []), *[fk.column for fk in drop]])
            df = t.get(name, *needed) if cols else t.get(name)
            if name == root:
                df = df.join(accepted, pk, "left_anti")
            for fk in drop:
                gone = hashed(deleted_keys[fk.parent].select(F.col(_key_of(fk)).alias(fk.column)), t.tasks(name))
                df = df.join(gone, fk.column, "left_anti")
            for fk in clear:
                if fk.column not in df.columns:
                    continue
                hit = deleted_keys[fk.parent].select(F.col(_key_of(fk)).alias("__gone")).distinct().withColumn("__hit", F.lit(True))
                kept = F.when(F.col("__hit").isNull(), F.col(fk.column)).alias(fk.column)
                df = (df.join(hit, F.col(fk.column) == F.col("__gone"), "left")
                      .select(*[kept if c == fk.column else F.col(c) for c in df.columns]))
            return df.select(*wanted)
        return build

    touched = list(dict.fromkeys([*closure, *[fk.child for fk in nulled]]))
    return DeleteResult(t.rebuild({name: survivors(name) for name in touched}), touched, accepted, rejected, nulled)


def change_report(result: DeleteResult) -> DataFrame:
    """(item, n): rows left in each touched table, non-NULL references left by each SET NULL edge,
    and the number of deleted and rejected root keys."""
    def one(name: str) -> str:
        """A column that is cheap to build: one that the rules read anyway."""
        edges = [fk.column for fk in schema.parents_of(name) if fk.on_delete == schema.CASCADE]
        return edges[0] if edges else schema.table(name).primary_key[0]

    parts = [result.tables.get(name, one(name)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
             for name in result.touched]
    for fk in result.set_null:
        parts.append(result.tables.get(fk.child, fk.column).agg(F.count(fk.column).alias("n"))
                     .select(F.lit(f"{fk.child}.{fk.column}").alias("item"), "n"))
    parts.append(result.deleted.agg(F.count(F.lit(1)).alias("n")).select(F.lit("keys_deleted").alias("item"), "n"))
    parts.append(result.rejected.agg(F.count(F.lit(1)).alias("n")).select(F.lit("keys_rejected").alias("item"), "n"))
    return reduce(DataFrame.unionByName, parts)


def cascade_paths(root: str) -> dict[str, list[tuple[schema.ForeignKey, ...]]]:
    """Every table a delete from ``root`` can reach, with the chains of edges that reach it: CASCADE edges, and at the end
    possibly a SET NULL edge. The place of a chain in its list is its bit in ``explain_delete``."""
    out: dict[str, list[tuple[schema.ForeignKey, ...]]] = {root: [()]}
    for name in schema.cascade_closure(root):
        for fk in schema.children_of(name):
            if fk.on_delete in (schema.CASCADE, schema.SET_NULL):
                chains = [c for c in out[name] if all(e.on_delete == schema.CASCADE for e in c)]
                out.setdefault(fk.child, []).extend((*c, fk) for c in chains)
    return out


def path_name(chain: tuple[schema.ForeignKey, ...]) -> str:
    return " > ".join(f"{fk.child}.{fk.column}" for fk in chain)


def _key_text(name: str) -> Column:
    return F.concat_ws(":", *[F.col(c).cast("string") for c in schema.table(name).primary_key])


def explain_delete(t: Tables, root: str, keys: DataFrame) -> DataFrame:
    """What a delete does, row by row: (table_name, row_key, outcome, paths). Outcomes: ``deleted``, ``set null`` (its
    reference is cleared) and ``refused`` (a root row that a blocking child still refers to). ``paths`` are the chains of
    references that reach the row, in order; for a refused row the tables that block it. Each row carries its chains as a
    bit set: an edge moves the parent's bits to those of the longer chains, and a row reached over several edges or
    parents takes the union (``bit_or``, map-side first, so a hot parent costs one row a task)."""
    schema.check_graph_invariants()
    pk, chains = list(schema.table(root).primary_key), cascade_paths(root)
    if max(map(len, chains.values())) > 62:
        raise ValueError(f"{root}: more chains than bits")
    targets = t.get(root, *pk).join(keys.select(*pk), pk, "left_semi")
    blocking = [fk for fk in schema.children_of(root) if fk.on_delete in schema.BLOCKING]
    flags = targets
    for i, fk in enumerate(blocking):
        refs = t.get(fk.child, fk.column).select(F.col(fk.column).alias(_key_of(fk))).distinct().withColumn(f"b{i}", F.lit(fk.child))
        flags = flags.join(refs, _key_of(fk), "left")
    by = F.concat_ws(", ", F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.col(f"b{i}") for i in range(len(blocking))]))))) if blocking else F.lit("")
    judged = _pin(flags.select(*pk, by.alias("blocked_by")), True)
    reached = {root: judged.filter("blocked_by = ''").select(*pk, F.lit(1).cast("long").alias("bits"))}
    parts = [judged.filter("blocked_by <> ''").select(F.lit(root).alias("table_name"), _key_text(root).alias("row_key"),
                                                      F.lit("refused").alias("outcome"), F.col("blocked_by").alias("paths"))]

    def named(name: str, rows: DataFrame, outcome: str) -> DataFrame:
        told = F.concat_ws(", ", F.array_sort(F.array_compact(F.array(*[
            F.when(F.col("bits").bitwiseAND(F.lit(1 << i)) != 0, F.lit(path_name(c))) for i, c in enumerate(chains[name])]))))
        return rows.select(F.lit(name).alias("table_name"), _key_text(name).alias("row_key"), F.lit(outcome).alias("outcome"), told.alias("paths"))

    parts.append(named(root, reached[root], "deleted"))
    order = schema.cascade_closure(root)
    for name in [*order[1:], *[n for n in chains if n not in order]]:
        own = list(schema.table(name).primary_key)
        for outcome, rule in (("deleted", schema.CASCADE), ("set null", schema.SET_NULL)):
            met = []
            for fk in [fk for fk in schema.parents_of(name) if fk.on_delete == rule and fk.parent in reached]:
                moved = [F.when(F.col("bits").bitwiseAND(F.lit(1 << chains[fk.parent].index(c[:-1]))) != 0, F.lit(1 << i)).otherwise(0)
                         for i, c in enumerate(chains[name]) if c[-1] == fk and c[:-1] in chains[fk.parent]]
                parents = reached[fk.parent].select(F.col(_key_of(fk)).alias(fk.column), reduce(Column.bitwiseOR, moved).cast("long").alias("bits"))
                met.append(t.get(name, *dict.fromkeys([*own, fk.column])).join(hashed(parents, t.tasks(name)), fk.column).select(*own, "bits"))
            if met:
                rows = spread(reduce(DataFrame.unionByName, met), t.tasks(name), *own).groupBy(*own).agg(F.bit_or("bits").alias("bits"))
                if outcome == "deleted":
                    onward = any(fk.on_delete in (schema.CASCADE, schema.SET_NULL) for fk in schema.children_of(name))
                    reached[name] = rows = _pin(rows, onward)
                parts.append(named(name, rows, outcome))
    return reduce(DataFrame.unionByName, parts)
