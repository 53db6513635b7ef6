"""T9 ``encode``: one-hot, label, ordinal, target, frequency and hashing encoders.

Value maps stay DataFrames and are joined, broadcast when their measured bytes allow it and
by a shuffle join (with AQE skew splitting) beyond that; so the result has one type at
every size. Only maps that the caller writes down (ordinal) are literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.exprs import bounded_broadcast, stable_hash
from tamis.functions.ordering import PositionKernel, ordered_scan
from tamis.operators.base import FittedStep, Step, StepError, clamp, col, register_step, replace_columns
from tamis.session import reliable_checkpoint

METHODS = ("onehot", "label", "ordinal", "target_encode", "frequency_encode", "hashing_encode")
ONEHOT_COLUMNS = 100


def literal_lookup(x: Column, mapping: dict) -> Column:
    if not mapping:
        return F.lit(None)
    m = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return F.element_at(m, x)


def join_lookup(df: DataFrame, c: str, table: DataFrame, value_col: str, as_string=False) -> DataFrame:
    """Replace column ``c`` by ``table[value_col]`` matched on the key ``__k``."""
    t = bounded_broadcast(table.withColumnRenamed(value_col, "__v"))
    key = col(c).cast("string") if as_string else col(c)
    joined = df.join(t, key == F.col("__k"), "left")
    return joined.select(*[F.col("__v").alias(c) if x == c else col(x) for x in df.columns])


def onehot_values(df: DataFrame, c: str, max_categories=None, rare_label="OTHER", max_columns=ONEHOT_COLUMNS):
    """The values with a column of their own, and those kept when the rest is grouped (else None)."""
    s = col(c).cast("string")
    counts = df.where(s.isNotNull()).groupBy(s.alias("v")).count()
    if max_categories:
        top = counts.orderBy(F.desc("count"), F.asc("v")).limit(int(max_categories) + 1).collect()
        keep = [r["v"] for r in top[: int(max_categories)]]
        return sorted(keep + ([rare_label] if len(top) > len(keep) else [])), keep
    values = [r["v"] for r in counts.orderBy("v").limit(max_columns + 1).collect()]
    if len(values) > max_columns:
        raise StepError(f"encode: column {c!r} has more than {max_columns} values; set max_categories or max_columns")
    return values, None


def ordinal_value(df: DataFrame, c: str, mapping: dict, unmapped: str) -> Column:
    """Mapped values; numbers where every value is mapped or the unmapped become NULL, else text."""
    looked = literal_lookup(col(c).cast("string"), {str(k): v for k, v in mapping.items()})
    numeric = all(isinstance(v, (int, float)) for v in mapping.values())
    kind = "bigint" if all(isinstance(v, int) for v in mapping.values()) else "double"
    if unmapped == "null":
        return looked.cast("double") if numeric else looked
    left = df.where(col(c).isNotNull() & ~col(c).cast("string").isin([str(k) for k in mapping])).limit(1).count()
    if numeric and not left:
        return looked.cast(kind)
    return F.coalesce(looked.cast("string"), col(c).cast("string"))


@register_step("encode")
class Encode(Step):
    required = ("columns", "method")

    def check_params(self):
        m = self.params["method"]
        if m not in METHODS:
            raise StepError(f"encode: invalid method {m!r}")
        if m == "target_encode" and not self.params.get("target_column"):
            raise StepError("encode: target_encode needs 'target_column'")

    def fit(self, df: DataFrame) -> FittedStep:
        p = self.params
        m, cols = p["method"], list(p["columns"])
        if m == "onehot":
            return self._onehot(df, cols)
        if m == "hashing_encode":
            return self._hashing(cols)
        if m == "ordinal":
            maps = p.get("ordinal_mappings") or {}
            exprs = {c: ordinal_value(df, c, maps[c], p.get("unmapped", "keep")) for c in cols if c in maps}
            return FittedStep(self.kind, p, {"mappings": maps}, lambda d: replace_columns(d, exprs))
        encoders = []
        for c in cols:
            known = df.where(col(c).isNotNull()).groupBy(col(c).alias("__k"))
            if m == "label":
                encoders.append((c, label_codes(df, c), "code", True))
            elif m == "target_encode":
                encoders.append((c, known.agg(F.avg(col(p["target_column"]).cast("double")).alias("mean")), "mean", False))
            else:
                encoders.append((c, known.agg(F.count(F.lit(1)).alias("count")), "count", False))
        encoders = [(c, reliable_checkpoint(table), value, text) for c, table, value, text in encoders]

        def transform(d: DataFrame) -> DataFrame:
            for c, table, value, as_string in encoders:
                d = join_lookup(d, c, table, value, as_string)
            return d

        return FittedStep(self.kind, p, {"sizes": {c: table.count() for c, table, _, _ in encoders}}, transform)

    def _onehot(self, df, cols):
        p = self.params
        maxc = p.get("max_categories")
        maxc = clamp(int(maxc), 2, 1000) if maxc else None
        rare = "Rare" if p.get("group_rare") else "OTHER"
        plan = {}
        for c in cols:
            values, keep = onehot_values(df, c, maxc, rare, int(p.get("max_columns", ONEHOT_COLUMNS)))
            plan[c] = (values, keep)

        def transform(d: DataFrame) -> DataFrame:
            out = []
            for x in d.columns:
                if x not in plan:
                    out.append(col(x))
                    continue
                values, keep = plan[x]
                s = col(x).cast("string")
                if keep is not None:
                    s = F.when(s.isNull(), s).when(s.isin(keep), s).otherwise(F.lit(rare))
                for v in values:
                    out.append(F.coalesce((s == F.lit(v)).cast("int"), F.lit(0)).alias(f"{x}_{v}"))
            return d.select(*out)

        return FittedStep(self.kind, p, {"categories": {c: v for c, (v, _) in plan.items()}}, transform)

    def _hashing(self, cols):
        p = self.params
        n = clamp(int(p.get("n_components", 8)), 1, 50)

        def transform(d: DataFrame) -> DataFrame:
            out = []
            for x in d.columns:
                if x not in cols:
                    out.append(col(x))
                    continue
                h = stable_hash([col(x).cast("string")], seed=0)
                b = F.pmod(h, F.lit(n))
                sign = F.when(F.pmod(stable_hash([col(x).cast("string")], seed=1), F.lit(2)) == 0, 1.0).otherwise(-1.0)
                for i in range(n):
                    out.append(F.when(col(x).isNotNull() & (b == i), sign).otherwise(F.lit(0.0)).alias(f"{x}_hash_{i}"))
            return d.select(*out)

        return FittedStep(self.kind, p, {"n_components": n}, transform)


def label_codes(df: DataFrame, c: str) -> DataFrame:
    """(``__k``, ``code``): codes from 0 in sorted order of the text value.

    An ordered scan over the distinct values numbers them, so no single task sorts them all.
    """
    distinct = df.select(col(c).cast("string").alias("__k")).where("__k IS NOT NULL").distinct()
    return ordered_scan(distinct, PositionKernel("code"), ["__k"]).select("__k", "code")
