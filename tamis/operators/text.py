"""T3 ``normalize_text`` and T17 ``clean_text``: regular expressions run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.functions.exprs import bounded_broadcast
from tamis.functions.fixed import ENGLISH_STOP_WORDS, TOKEN_PATTERN
from tamis.operators.base import FittedStep, Step, StepError, col, register_step, replace_columns


def normalize_expr(x: Column, lower=True, trim=True, collapse=True, remove_special=False) -> Column:
    s = x.cast("string")
    if lower:
        s = F.lower(s)
    if trim:
        s = F.regexp_replace(s, r"^\s+|\s+$", "")
    if collapse:
        s = F.regexp_replace(s, r"\s+", " ")
    if remove_special:
        # \w in Java is ASCII only; letters and digits of any script are kept.
        s = F.regexp_replace(s, r"[^\p{L}\p{N}_\s]", "")
    return s


@register_step("normalize_text")
class NormalizeText(Step):
    required = ("columns",)

    def fit(self, df: DataFrame) -> FittedStep:
        p = self.params
        opts = {k: p.get(k, d) for k, d in (("lower", True), ("trim", True), ("collapse", True), ("remove_special", False))}
        exprs = {c: normalize_expr(col(c), **opts) for c in p["columns"]}
        return FittedStep(self.kind, p, {}, lambda d: replace_columns(d, exprs))


def tokens_expr(x: Column, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(F.lower(x.cast("string")), F.lit(pattern), 0)


LITERAL_LEMMAS = 200  # entries up to which the caller's lemmas are a literal in the plan


def cleaned_tokens(x: Column, remove_stopwords=False) -> Column:
    toks = tokens_expr(x)
    if remove_stopwords:
        # a literal IN list becomes a hash-set lookup (InSet) inside the lambda
        toks = F.filter(toks, lambda t: ~t.isin(*ENGLISH_STOP_WORDS) & (F.char_length(t) > 1))
    return toks


def clean_text_expr(x: Column, remove_stopwords=False, lemmas: dict | None = None) -> Column:
    toks = cleaned_tokens(x, remove_stopwords)
    if lemmas:
        m = F.create_map(*[F.lit(v) for kv in sorted(lemmas.items()) for v in kv])
        toks = F.transform(toks, lambda t: F.coalesce(F.element_at(m, t), t))
    return F.when(x.isNull(), F.lit("")).otherwise(F.array_join(toks, " "))


def lemma_table(lemmas, spark) -> DataFrame:
    """(token, lemma) from a DataFrame with these columns or a dict: lower-case tokens, the smallest lemma of a token that repeats."""
    if isinstance(lemmas, DataFrame):
        table = lemmas.select(F.lower(F.col("token").cast("string")).alias("token"), F.col("lemma").cast("string").alias("lemma"))
    else:
        table = spark.createDataFrame([(str(k).lower(), str(v)) for k, v in lemmas.items()], "token string, lemma string")
    return table.where("token IS NOT NULL AND lemma IS NOT NULL").groupBy("token").agg(F.min("lemma").alias("lemma"))


def clean_text_by_table(df: DataFrame, c: str, remove_stopwords: bool, lemmas: DataFrame) -> DataFrame:
    """Tokens go through a join with the lemma table, broadcast if its measured size allows it, and back into their row in order.

    The row's other columns travel with its first token only. A token without a lemma stays.
    """
    tokens = F.when(col(c).isNotNull(), cleaned_tokens(col(c), remove_stopwords))
    rows = df.select(F.monotonically_increasing_id().alias("__row"), F.struct(*[col(x) for x in df.columns]).alias("__own"), tokens.alias("__tokens"))
    places = rows.select("__row", "__own", F.posexplode_outer("__tokens").alias("__place", "token"))
    own = F.when(F.coalesce("__place", F.lit(0)) == 0, F.col("__own")).alias("__own")
    joined = places.select("__row", own, "__place", "token").join(bounded_broadcast(lemmas), "token", "left")
    item = F.when(F.col("token").isNotNull(), F.struct("__place", F.coalesce("lemma", "token").alias("t")))
    back = joined.groupBy("__row").agg(F.first("__own", ignorenulls=True).alias("__own"), F.sort_array(F.collect_list(item)).alias("__items"))
    text = F.array_join(F.transform("__items", lambda x: x["t"]), " ")
    return back.select(*[text.alias(x) if x == c else F.col("__own")[x].alias(x) for x in df.columns])


@register_step("clean_text")
class CleanText(Step):
    """Lower-case, tokenise and re-join; optional stop words and a lemma table (a dict, or a DataFrame of token and lemma)."""

    required = ("column",)

    def check_params(self):
        lemmas = self.params.get("lemmas")
        if isinstance(lemmas, DataFrame):
            if not {"token", "lemma"} <= set(lemmas.columns):
                raise StepError("clean_text: a lemma table needs the columns token and lemma")
        elif lemmas is not None and not isinstance(lemmas, dict):
            raise StepError("clean_text: 'lemmas' must be a dict or a DataFrame")
        self.rowwise = lemmas is None or isinstance(lemmas, dict) and len(lemmas) <= LITERAL_LEMMAS

    def fit(self, df: DataFrame) -> FittedStep:
        p = self.params
        c, drop = p["column"], bool(p.get("remove_stopwords", False))
        lemmas = p.get("lemmas") if p.get("lemmatize", p.get("lemmas") is not None) else None
        if lemmas is None or isinstance(lemmas, dict) and len(lemmas) <= LITERAL_LEMMAS:
            e = clean_text_expr(col(c), drop, lemmas)
            return FittedStep(self.kind, p, {}, lambda d: replace_columns(d, {c: e}))
        table = lemma_table(lemmas, df.sparkSession)
        return FittedStep(self.kind, p, {}, lambda d: clean_text_by_table(d, c, drop, table))


def extract_domain_expr(x: Column) -> Column:
    """Authority of the URL (user info and port kept), lower-cased.

    A missing or blank value gives ""; a value without ``http(s)://`` gets ``http://``;
    an authority without a dot (or over 253 characters) returns the prefixed text.
    """
    s = F.regexp_replace(x.cast("string"), r"^\s+|\s+$", "")
    u = F.when(s.startswith("http://") | s.startswith("https://"), s).otherwise(F.concat(F.lit("http://"), s))
    dom = F.lower(F.regexp_extract(u, r"^https?://([^/?#]*)", 1))
    return (
        F.when(x.isNull() | (s == ""), F.lit(""))
        .when(~dom.contains(".") | (F.char_length(dom) > 253), u)
        .otherwise(dom)
    )


@register_step("extract_domain")
class ExtractDomain(Step):
    required = ("column",)

    def fit(self, df: DataFrame) -> FittedStep:
        c = self.params["column"]
        return FittedStep(self.kind, self.params, {}, lambda d: replace_columns(d, {c: extract_domain_expr(col(c))}))
