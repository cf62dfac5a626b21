"""Vocabulary normalisation against a dictionary of canonical names, aliases and codes.

Dictionary frame: domain, canonical, aliases ARRAY<STRING>, codes MAP<STRING,STRING>, category,
subcategory, unit, description, relations ARRAY<MAP<STRING,STRING>>.
Only distinct terms are looked up. Exact matches are an equi-join on (domain, token); composite
matches cut each unmatched token into its substrings of the lengths the dictionary knows and
equi-join those, so no term ever meets the whole dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from terraloom import fixed_values as fv
from terraloom.functions import scoring, values as V
from terraloom.functions.skew import HOT_SHARE, join_by_weight
from terraloom.functions.values import q
from terraloom.session import cut_lineage

DICTIONARY_SCHEMA = (
    "domain string, canonical string, aliases array<string>, codes map<string,string>, category string,"
    " subcategory string, unit string, description string, relations array<map<string,string>>"
)
CANONICAL, CODE, ALIAS = 0, 1, 2
JOINER = "；"


@F.pandas_udf(T.StringType())
def _nfkc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.str.normalize("NFKC")


def fold_token(text: Column) -> Column:
    """Lower case without blanks, dashes, punctuation and brackets (after NFKC)."""
    return F.regexp_replace(F.lower(text), "(?U)" + fv.TOKEN_DROP_PATTERN, "")


def with_token(df: DataFrame, column: str, out: str = "token") -> DataFrame:
    """Add the normalised token of a column of distinct values (NFKC has no built-in function)."""
    return df.withColumn(out, fold_token(_nfkc(F.coalesce(q(column), F.lit("")))))


def alias_list(text: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), fv.ALIAS_SPLIT_PATTERN), V.strip)
    return F.filter(parts, lambda p: p != "")


def normalise_codes(codes: Column, legacy: Column | None = None) -> Column:
    """Upper-case code systems, blank codes dropped; a legacy single code becomes PROJECT."""
    entries = F.filter(F.map_entries(F.coalesce(codes, F.expr("map()").cast("map<string,string>"))), lambda e: V.strip(e["value"]) != "")
    entries = F.transform(entries, lambda e: F.struct(F.upper(e["key"]).alias("key"), V.strip(e["value"]).alias("value")))
    clean = F.map_from_entries(entries)
    if legacy is None:
        return clean
    usable = (V.strip(legacy) != "") & ~F.array_contains(F.map_keys(clean), "PROJECT")
    return F.when(usable, F.map_concat(clean, F.create_map(F.lit("PROJECT"), V.strip(legacy)))).otherwise(clean)


def canonical_domain(domain: Column) -> Column:
    known = {**fv.DOMAIN_ALIASES, **{d: d for d in fv.DOMAINS}}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    text = V.strip(domain)
    return F.coalesce(F.try_element_at(table, text), F.try_element_at(table, F.lower(text)))


def term_index(dictionary: DataFrame) -> DataFrame:
    """(domain, token, canonical, priority, system): one row per canonical name, alias and code."""
    names = dictionary.select(
        "domain", "canonical",
        F.explode(
            F.concat(
                F.array(F.struct(F.col("canonical").alias("text"), F.lit(CANONICAL).alias("priority"), F.lit("CANONICAL").alias("system"))),
                F.transform(
                    F.coalesce("aliases", F.array().cast("array<string>")),
                    lambda a: F.struct(a.alias("text"), F.lit(ALIAS).alias("priority"), F.lit("ALIAS").alias("system")),
                ),
                F.transform(
                    F.map_entries(normalise_codes(F.col("codes"))),
                    lambda e: F.struct(e["value"].alias("text"), F.lit(CODE).alias("priority"), e["key"].alias("system")),
                ),
            )
        ).alias("t"),
    ).select("domain", "canonical", "t.*")
    return (
        with_token(names, "text")
        .filter("token <> ''")
        .dropDuplicates(["domain", "token", "canonical", "system"])
        .select("domain", "token", "canonical", "priority", "system")
    )


def _lookup(index: DataFrame) -> DataFrame:
    """Candidates of one token: best first by (priority, canonical)."""
    per_name = index.groupBy("domain", "token", "canonical").agg(F.min(F.struct("priority", "system")).alias("p"))
    ordered = F.array_sort(F.collect_list(F.struct("p.priority", "canonical", "p.system")))
    return per_name.groupBy("domain", "token").agg(ordered.alias("found"))


def match_terms(terms: DataFrame, index: DataFrame, strategy: str = "prefer_canonical") -> DataFrame:
    """Match distinct (domain, raw) terms.

    Adds token, canonical, matched_by, confidence, candidates and matched_terms. Strategies:
    prefer_canonical, longest (one composite match only), keep_original (no composites, and an
    ambiguous term keeps its own text).
    """
    lookup = _lookup(index)
    keyed = with_token(terms, "raw")
    exact = keyed.join(lookup, ["domain", "token"], "left")
    best = F.col("found")[0]
    base = F.when(best["priority"] == CANONICAL, 1.0).when(best["priority"] == CODE, 0.97).otherwise(0.95)
    many = F.size("found") > 1
    kind = F.when(best["priority"] == CANONICAL, "canonical").when(best["priority"] == CODE, F.concat(F.lit("code:"), best["system"])).otherwise("alias")
    keep = F.lit(strategy == "keep_original")
    hit = exact.filter(F.col("found").isNotNull()).select(
        *terms.columns, "token",
        F.when(many & keep, V.strip(F.col("raw"))).otherwise(best["canonical"]).alias("canonical"),
        F.when(many & keep, "ambiguous_kept").otherwise(kind).alias("matched_by"),
        F.when(many & keep, 0.0).when(many, F.greatest(F.lit(0.55), base - 0.15)).otherwise(base).alias("confidence"),
        F.transform("found", lambda f: f["canonical"]).alias("candidates"),
        F.when(many & keep, F.array().cast("array<string>")).otherwise(F.array(best["canonical"])).alias("matched_terms"),
    )
    rest = exact.filter(F.col("found").isNull()).select(*terms.columns, "token")
    if strategy == "keep_original":
        return hit.unionByName(_unmatched(rest))
    return hit.unionByName(_composite(rest, index, strategy == "longest"))


def _unmatched(rest: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return rest.select(
        "*", V.strip(F.col("raw")).alias("canonical"), F.lit("none").alias("matched_by"), F.lit(0.0).alias("confidence"),
        none.alias("candidates"), none.alias("matched_terms"),
    )


def _composite(rest: DataFrame, index: DataFrame, longest_only: bool) -> DataFrame:
    words = (
        index.filter((F.length("token") >= 2) & (F.col("domain") != fv.EXACT_ONLY_DOMAIN))
        .groupBy("domain", "token").agg(F.min("canonical").alias("canonical"))
    )
    sizes = words.groupBy("domain").agg(F.collect_set(F.length("token")).alias("sizes"))
    tokens = rest.select("domain", "token").filter(F.length("token") >= 2).distinct()
    pieces = (
        tokens.join(sizes, "domain")
        .select("domain", "token", F.explode("sizes").alias("n"))
        .filter(F.col("n") <= F.length("token"))
        .select("domain", "token", "n", F.explode(F.sequence(F.lit(1), F.length("token") - F.col("n") + 1)).alias("start"))
        .withColumn("piece", F.substr("token", "start", "n"))
    )
    spans = (
        pieces.join(words.withColumnRenamed("token", "piece"), ["domain", "piece"])
        .groupBy("domain", "token", "piece")  # a word counts where it first occurs
        .agg(F.min("start").alias("start"), F.first("n").alias("n"), F.first("canonical").alias("canonical"))
        .groupBy("domain", "token")
        .agg(F.collect_list(F.struct((-F.col("n")).alias("neg"), "start", "canonical", (F.col("start") + F.col("n")).alias("stop"))).alias("spans"))
    )
    outer = F.filter(
        "spans",
        lambda s: ~F.exists("spans", lambda o: (o["neg"] < s["neg"]) & (o["start"] <= s["start"]) & (o["stop"] >= s["stop"])),
    )
    ranked = spans.withColumn("spans", F.array_sort(outer))
    once = F.filter(
        "spans", lambda s, i: ~F.exists(F.slice("spans", 1, i), lambda earlier: earlier["canonical"] == s["canonical"])
    )
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["neg"], s["canonical"])))
    named = ranked.withColumn("spans", once).withColumn("names", F.transform(by_place, lambda s: s["canonical"]))
    if longest_only:
        named = named.withColumn("names", F.slice("names", 1, 1))
    joined = rest.join(named.select("domain", "token", "names"), ["domain", "token"], "left")
    found = F.col("names").isNotNull()
    none = F.array().cast("array<string>")
    return joined.select(
        *[c for c in rest.columns],
        F.when(found, F.array_join("names", JOINER)).otherwise(V.strip(F.col("raw"))).alias("canonical"),
        F.when(found, "longest_substring" if longest_only else "composite").otherwise("none").alias("matched_by"),
        F.when(found, 0.72).otherwise(0.0).alias("confidence"),
        none.alias("candidates"),
        F.coalesce("names", none).alias("matched_terms"),
    )


def attach_entries(matched: DataFrame, dictionary: DataFrame, target_system: str = "PROJECT") -> DataFrame:
    """Codes and classes of the matched entries; several entries are joined in match order."""
    entry = dictionary.select(
        "domain", F.col("canonical").alias("name"), normalise_codes(F.col("codes")).alias("codes"), "category", "subcategory", "unit"
    )
    named = matched.select("domain", "raw", F.posexplode("matched_terms").alias("pos", "name")).join(entry, ["domain", "name"], "left")

    def in_order(cell: Column, sep: str) -> Column:
        sorted_ = F.array_sort(F.collect_list(F.struct("pos", F.coalesce(cell, F.lit("")).alias("v"))))
        texts = F.array_distinct(F.transform(sorted_, lambda s: s["v"]))
        return F.array_join(F.filter(texts, lambda t: t != ""), sep)

    code = lambda system: F.try_element_at(F.col("codes"), F.lit(system))
    facts = named.groupBy("domain", "raw").agg(
        in_order(code("PROJECT"), "|").alias("project_code"), in_order(code("SYMBOL"), "|").alias("symbol"),
        in_order(code(target_system), "|").alias("target_code"), in_order(F.col("category"), JOINER).alias("category"),
        in_order(F.col("subcategory"), JOINER).alias("subcategory"), in_order(F.col("unit"), JOINER).alias("unit"),
    )
    names = ["project_code", "symbol", "target_code", "category", "subcategory", "unit"]
    joined = matched.join(facts, ["domain", "raw"], "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit("")) for n in names})


def resolve_conflicts(mappings: DataFrame, policy: str = "review") -> DataFrame:
    """review / keep_original: an ambiguous term keeps its text and gets no code; override: best candidate."""
    if policy == "override":
        return mappings
    clash = F.size("candidates") > 1
    blank = {c: F.when(clash, "").otherwise(F.col(c)) for c in ("project_code", "symbol", "target_code") if c in mappings.columns}
    return mappings.withColumns(
        {
            "canonical": F.when(clash, V.strip(F.col("raw"))).otherwise(F.col("canonical")),
            "matched_by": F.when(clash, "conflict_review" if policy == "review" else "conflict_kept").otherwise(F.col("matched_by")),
            **blank,
        }
    )


def conflicts(mappings: DataFrame, policy: str = "review") -> DataFrame:
    resolution = F.when(F.lit(policy == "override"), F.concat(F.lit("use "), F.col("canonical"))).otherwise(policy)
    return mappings.filter(F.size("candidates") > 1).select(
        *[c for c in ("field", "domain", "raw") if c in mappings.columns], F.array_join("candidates", "、").alias("candidates"),
        resolution.alias("resolution"),
    )


def unmapped(mappings: DataFrame) -> DataFrame:
    return mappings.filter("confidence = 0")


def relations(mappings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Relations of the matched entries, one row per mapping and relation."""
    entry = dictionary.select("domain", F.col("canonical").alias("name"), "relations")
    keep = [c for c in ("field",) if c in mappings.columns]
    return (
        mappings.select(*keep, "domain", "raw", F.col("canonical").alias("source_term"), F.explode("matched_terms").alias("name"))
        .join(entry, ["domain", "name"])
        .select(*keep, "domain", "raw", "source_term", F.explode("relations").alias("relation"))
    )


def coverage(mappings: DataFrame) -> DataFrame:
    """Terms, mapped, unmapped and coverage per domain and in total (domain null)."""
    return (
        mappings.rollup("domain")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("confidence") > 0).alias("mapped"))
        .withColumn("unmapped", F.col("total") - F.col("mapped"))
        .withColumn("coverage", F.round(F.coalesce(F.try_divide(F.col("mapped"), F.col("total")), F.lit(0.0)), 4))
    )


def semantic_score(mappings: DataFrame, extra_penalty: int = 0) -> DataFrame:
    """One row: every unmapped term is a warning; coverage and conflicts cost extra."""
    facts = mappings.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("confidence") > 0).alias("mapped"),
        F.count_if(F.size("candidates") > 1).alias("conflicts"), F.count_if(F.col("confidence") == 0).alias("unmapped"),
    )
    covered = F.round(F.coalesce(F.try_divide(F.col("mapped"), F.col("total")), F.lit(0.0)), 4)
    shortfall = F.when(F.col("total") > 0, F.bround((1 - covered) * 35)).otherwise(10)
    cost = (
        F.col("unmapped") * fv.SEMANTIC_PENALTY[fv.WARNING] + shortfall + F.least(F.lit(15), F.col("conflicts") * 3) + extra_penalty
    )
    scored = facts.withColumn("coverage", covered).withColumn("score", scoring.clamp_score(F.lit(100) - cost))
    return scored.withColumn("grade", scoring.grade(F.col("score")))


# --- dictionaries -------------------------------------------------------------------------


def dictionary_stats(dictionary: DataFrame) -> DataFrame:
    """Terms, aliases and codes per domain and in total (domain null)."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return dictionary.rollup("domain").agg(
        F.count(F.lit(1)).alias("terms"), F.sum(size(F.coalesce("aliases", F.array().cast("array<string>")))).alias("aliases"),
        F.sum(size(F.map_keys(normalise_codes(F.col("codes"))))).alias("codes"),
    )


def audit_dictionary(dictionary: DataFrame) -> DataFrame:
    """Tokens and codes claimed by several names, one row per name, and names without a PROJECT code.

    The names of a token are counted and joined back, never gathered: a token may belong to any number of them.
    """
    index = term_index(dictionary)
    kind = F.when(F.col("priority") == CODE, "code_conflict").otherwise("alias_conflict")
    system = F.when(F.col("priority") == CODE, F.col("system")).otherwise("")
    claims = cut_lineage(index.select(kind.alias("problem"), "domain", system.alias("system"), "token", "canonical").distinct())
    key = ["problem", "domain", "system", "token"]
    several = cut_lineage(claims.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*key))
    missing = dictionary.filter(F.coalesce(F.try_element_at(normalise_codes(F.col("codes")), F.lit("PROJECT")), F.lit("")) == "").select(
        F.lit("missing_project_code").alias("problem"), "domain", F.lit("PROJECT").alias("system"), F.lit("").alias("token"), "canonical"
    )
    return claims.join(several, key, "left_semi").unionByName(missing)


def merge_dictionaries(base: DataFrame, additions: DataFrame) -> DataFrame:
    """Overlay additions: alias union in order, new codes win, other fields replaced where given."""
    add = additions.withColumn("domain", canonical_domain(F.col("domain"))).filter(
        F.col("domain").isNotNull() & (F.coalesce("canonical", F.lit("")) != "")
    )
    b = base.select("domain", "canonical", *[F.col(c).alias(f"b_{c}") for c in base.columns if c not in ("domain", "canonical")])
    a = add.select("domain", "canonical", *[F.col(c).alias(f"a_{c}") for c in base.columns if c not in ("domain", "canonical")])
    both = b.join(a, ["domain", "canonical"], "full_outer")
    none = F.array().cast("array<string>")
    old, new = normalise_codes(F.col("b_codes")), normalise_codes(F.col("a_codes"))
    return both.select(
        "domain", "canonical",
        F.array_distinct(F.concat(F.coalesce("b_aliases", none), F.coalesce("a_aliases", none))).alias("aliases"),
        F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new).alias("codes"),
        *[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in ("category", "subcategory", "unit", "description", "relations")],
    )


def dictionary_columns(headers: Sequence[str]) -> dict[str, str] | None:
    """Which header plays which dictionary role; None unless domain and canonical are there."""
    import re
    import unicodedata

    fold = lambda h: re.sub(fv.TOKEN_DROP_PATTERN, "", unicodedata.normalize("NFKC", h).strip().lower())
    folded = {fold(h): h for h in headers}
    found = {
        role: next(folded[fold(n)] for n in names if fold(n) in folded)
        for role, names in fv.DICTIONARY_HEADERS.items()
        if any(fold(n) in folded for n in names)
    }
    return found if {"domain", "canonical"} <= found.keys() else None


def dictionary_from_table(df: DataFrame) -> DataFrame:
    """Dictionary frame from a table with recognisable headers; the last row of a name wins nothing:
    rows of one (domain, canonical) are merged."""
    roles = dictionary_columns(df.columns)
    if roles is None:
        raise ValueError("no domain and canonical columns")
    cell = lambda role: V.strip(q(roles[role])) if role in roles else F.lit(None).cast("string")
    codes = F.map_filter(
        F.create_map(F.lit("PROJECT"), cell("project_code"), F.lit("SYMBOL"), cell("symbol")),
        lambda k, v: v.isNotNull() & (v != ""),
    )
    return df.select(
        canonical_domain(cell("domain")).alias("domain"), cell("canonical").alias("canonical"),
        alias_list(cell("aliases")).alias("aliases"), codes.alias("codes"),
        *[F.nullif(cell(r), F.lit("")).alias(r) for r in ("category", "subcategory", "unit", "description")],
        F.lit(None).cast("array<map<string,string>>").alias("relations"),
    ).filter("domain is not null and canonical <> ''")


def dictionary_from_rows(spark: SparkSession, rows: Sequence[Mapping]) -> DataFrame:
    names = [p.split(" ")[0] for p in DICTIONARY_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], DICTIONARY_SCHEMA)


# --- whole tables -------------------------------------------------------------------------


def field_domain(name: str) -> str | None:
    """Domain of a column by its header alone."""
    import re
    import unicodedata

    name = (name or "").strip()
    for domain, exact in fv.EXACT_FIELD_DOMAIN.items():
        if name in exact:
            return domain
    fold = lambda h: re.sub(fv.TOKEN_DROP_PATTERN, "", unicodedata.normalize("NFKC", h).strip().lower())
    token = fold(name)
    if not token or token in fv.NON_SEMANTIC_FIELDS or token in fv.NON_SEMANTIC_EXACT or token.endswith(fv.NON_SEMANTIC_SUFFIXES):
        return None
    return next((d for d, signals in fv.FIELD_SIGNALS.items() if any(fold(s) in token for s in signals)), None)


def not_null_term(token: Column) -> Column:
    return ~token.isin(*fv.NULL_WORDS["semantic"])


def infer_domains(
    df: DataFrame, columns: Sequence[str], index: DataFrame, order_by: str | None = None, rows: int | None = None, values: int | None = None
) -> DataFrame:
    """Domain of each column from its distinct terms: the best domain needs max(2, n div 2) sure hits.

    With ``rows`` and ``values`` only the first values of the first rows by ``order_by`` are looked at, repeats counted.
    """
    cell = lambda c: F.struct(F.lit(c).alias("field"), V.strip(q(c).cast("string")).alias("raw"))
    if rows is None:
        long = df.select(F.inline(F.array(*[cell(c) for c in columns]))).filter("raw is not null").distinct()
        sample = with_token(long, "raw").filter(not_null_term(F.col("token"))).select("field", "token").distinct()
    else:
        head = df.select(q(order_by).alias("row"), *[q(c) for c in columns]).orderBy("row").limit(rows)
        cells = with_token(head.select("row", F.inline(F.array(*[cell(c) for c in columns]))).filter("raw is not null"), "raw")
        nth = F.row_number().over(W.partitionBy("field").orderBy("row"))
        sample = cells.filter(not_null_term(F.col("token"))).withColumn("rn", nth).filter(F.col("rn") <= (values or rows))
    sample = cut_lineage(sample)
    sure = index.join(sample.select("token").distinct(), "token", "left_semi")
    sure = _lookup(sure).filter(F.size("found") == 1)  # an ambiguous token is never sure
    hits = sample.join(sure.select("domain", "token"), "token").groupBy("field", "domain").agg(F.count(F.lit(1)).alias("hits"))
    rank = F.array_position(F.array(*[F.lit(d) for d in fv.DOMAINS]), F.col("domain"))
    best = hits.groupBy("field").agg(F.max_by(F.struct("domain", "hits"), F.struct(F.col("hits"), -rank)).alias("b"))
    size = sample.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    return (
        size.join(best, "field")
        .filter(F.col("b.hits") >= F.greatest(F.lit(2), F.floor(F.col("n") / 2)))
        .select("field", F.col("b.domain").alias("domain"), F.col("b.hits").alias("hits"), F.col("n").alias("sampled"))
    )


def column_terms(df: DataFrame, field_domains: Mapping[str, str]) -> DataFrame:
    """Distinct (field, domain, raw) with the number of rows each stands for."""
    cells = [F.struct(F.lit(f).alias("field"), F.lit(d).alias("domain"), V.strip(q(f)).alias("raw")) for f, d in field_domains.items()]
    long = df.select(F.inline(F.array(*cells))).filter("raw is not null")
    # cut: the optimiser would move the test on the token below the count, where the Python function meets every row
    counted = cut_lineage(long.groupBy("field", "domain", "raw").agg(F.count(F.lit(1)).alias("rows")))
    return with_token(counted, "raw", "_t").filter(not_null_term(F.col("_t"))).drop("_t")


def map_columns(
    df: DataFrame, field_domains: Mapping[str, str], dictionary: DataFrame, strategy: str = "prefer_canonical",
    policy: str = "review", target_system: str = "PROJECT",
) -> DataFrame:
    """Mapping table: one row per (field, raw) with codes and confidence; no cap on distinct terms."""
    terms = cut_lineage(column_terms(df, field_domains))  # the data are read once; terms are few next to rows
    distinct = terms.select("domain", "raw").distinct()
    matched = attach_entries(match_terms(distinct, term_index(dictionary), strategy), dictionary, target_system)
    return resolve_conflicts(terms.join(matched, ["domain", "raw"]), policy)


def normalise_table(
    df: DataFrame, mappings: DataFrame, fields: Sequence[str], target_system: str = "PROJECT", labels: bool = False, hot_share: int = HOT_SHARE
) -> DataFrame:
    """Add seven columns per semantic field by joining the mapping table back.

    Frequent terms are broadcast, the others shuffle (see ``join_by_weight``); the mapping is computed once and ``df`` read once.
    """
    mappings = cut_lineage(mappings)
    total = mappings.groupBy("field").agg(F.sum("rows").alias("n")).agg(F.max("n")).first()[0] or 0
    out = df
    for f in fields:
        name = lambda part: f"{f}_{fv.MAPPED_COLUMN_LABELS[part] if labels else part}"
        lookup = mappings.filter(F.col("field") == f).select(
            F.col("raw").alias("_key"), F.col("rows").alias("_weight"), F.col("canonical").alias(name("canonical")),
            F.col("project_code").alias(name("project_code")), F.col("symbol").alias(name("symbol")),
            F.col("target_code").alias(name("target_code")), F.lit(target_system).alias(name("code_system")),
            F.col("matched_by").alias(name("matched_by")), F.col("confidence").alias(name("confidence")),
        )
        keyed = with_token(out.withColumn("_key", V.strip(q(f))), "_key", "_token")
        # blank cells and null words have no mapping, see column_terms
        out = join_by_weight(keyed, lookup, ["_key"], "_weight", total, hot_share, ~not_null_term(F.col("_token"))).drop("_key", "_token")
    return out


def translate_codes(values: DataFrame, dictionary: DataFrame, from_system: str, to_system: str) -> DataFrame:
    """Code (domain, value) -> canonical -> other code system, with the route as text."""
    source, target = from_system.upper(), to_system.upper()
    entries = dictionary.select("domain", "canonical", normalise_codes(F.col("codes")).alias("codes"))
    if source == "CANONICAL":
        keyed = entries.select("domain", F.col("canonical").alias("value"), "canonical", "codes", F.lit(1.0).alias("confidence"))
        found = values.join(keyed, ["domain", "value"], "left")
    elif source in ("PROJECT", "SYMBOL"):
        coded = entries.withColumn("code", F.try_element_at(F.col("codes"), F.lit(source))).filter("code is not null")
        keyed = with_token(coded, "code").filter("token <> ''").groupBy("domain", "token").agg(F.min_by(F.struct("canonical", "codes"), "canonical").alias("e"))
        found = (
            with_token(values, "value").join(keyed, ["domain", "token"], "left")
            .select(*values.columns, "e.canonical", "e.codes", F.when(F.col("e").isNotNull(), 1.0).alias("confidence"))
        )
    else:
        terms = values.select("domain", F.col("value").alias("raw")).distinct()
        matched = match_terms(terms, term_index(dictionary)).select("domain", F.col("raw").alias("value"), "canonical", "confidence")
        found = values.join(matched, ["domain", "value"], "left").join(entries, ["domain", "canonical"], "left")
    if target == "CANONICAL":
        mapped = F.col("canonical")
    elif target == "ORIGINAL":
        mapped = F.col("value")
    else:
        mapped = F.try_element_at(F.col("codes"), F.lit(target))
    ok = F.col("canonical").isNotNull() & (F.coalesce(mapped, F.lit("")) != "")
    head = F.concat(F.col("value"), F.lit(f" [{source}] → "))
    return found.select(
        *values.columns, F.when(ok, mapped).otherwise(F.col("value")).alias("mapped_value"),
        F.coalesce("canonical", "value").alias("canonical_name"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.when(ok, F.concat(head, F.col("canonical"), F.lit(" → "), mapped, F.lit(f" [{target}]")))
        .otherwise(F.concat(head, F.lit(f"no {target} code"))).alias("route"),
    )
