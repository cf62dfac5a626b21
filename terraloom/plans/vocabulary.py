"""Vocabulary report of several tables: dictionaries first, then the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from terraloom import fixed_values as fv
from terraloom.operators import semantic as S
from terraloom.plans.reports import Report
from terraloom.session import cut_lineage


def split_inputs(tables: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """(dictionary tables, data tables): a table with domain and canonical headers is a dictionary."""
    found = {n: S.dictionary_columns(df.columns) is not None for n, df in tables.items()}
    return {n: df for n, df in tables.items() if found[n]}, {n: df for n, df in tables.items() if not found[n]}


def semantic_fields(df: DataFrame, index: DataFrame, row_id: str, manual: Mapping[str, str] | None = None, domains: Sequence[str] | None = None) -> dict[str, str]:
    """Column -> domain: the manual map, then the header, then the first values."""
    manual = manual or {}
    known = {**fv.DOMAIN_ALIASES, **{d: d for d in fv.DOMAINS}}
    names = [c for c in df.columns if not c.startswith("_") and c != row_id]
    chosen = {c: known.get(manual[c], known.get(manual[c].lower())) if c in manual else S.field_domain(c) for c in names}
    open_ = [c for c, d in chosen.items() if d is None]
    if open_:
        chosen.update({r["field"]: r["domain"] for r in S.infer_domains(df, open_, index, row_id).collect()})  # one row per column
    allowed = set(domains or fv.DOMAINS)
    return {c: d for c, d in chosen.items() if d in allowed}


def vocabulary_report(
    tables: Mapping[str, DataFrame], dictionary: DataFrame, row_id: str = "_row_id", strategy: str = "prefer_canonical", policy: str = "review",
    field_domains: Mapping[str, str] | None = None, domains: Sequence[str] | None = None, target_system: str = "PROJECT",
) -> tuple[Report, dict[str, DataFrame]]:
    """(report, normalised tables). Frames: mappings, conflicts, unmapped, relations, coverage, stats, audit."""
    extra, data = split_inputs(tables)
    for df in extra.values():
        dictionary = S.merge_dictionaries(dictionary, S.dictionary_from_table(df))
    dictionary = cut_lineage(dictionary)
    index = S.term_index(dictionary)
    mappings, outputs, notes = None, {}, []
    for name, df in data.items():
        fields = semantic_fields(df, index, row_id, field_domains, domains)
        if not fields:
            notes.append((0, "semantic", "SEMANTIC_MAPPING", name, None, None, fv.INFO, "no vocabulary column recognised", ""))
            outputs[name] = df
            continue
        m = cut_lineage(S.map_columns(df, fields, dictionary, strategy, policy, target_system)).withColumn("file", F.lit(name))
        outputs[name] = S.normalise_table(df, m, list(fields), target_system)
        mappings = m if mappings is None else mappings.unionByName(m)
    from terraloom.operators import issues as I

    spark = dictionary.sparkSession
    noted = spark.createDataFrame(notes, I.ISSUE_SCHEMA)
    if mappings is None:
        mappings = spark.createDataFrame([], "file string, field string, domain string, raw string, rows bigint, canonical string, confidence double, candidates array<string>, matched_terms array<string>")
    lost = I.issue_rows(
        S.unmapped(mappings), check_no=1, category="semantic", code="SEMANTIC_MAPPING", file=F.col("file"), severity=fv.WARNING, field=F.col("field"),
        message=F.concat(F.col("raw"), F.lit(" is not in the dictionary of "), F.col("domain")), suggestion="add the term to the project dictionary",
    )
    issues = I.union_issues([noted, lost])
    report = Report(
        issues=I.number_issues(issues, "S"), categories=I.category_status(issues, ["semantic"]),
        summary=S.semantic_score(mappings, extra_penalty=len(notes) * fv.SEMANTIC_PENALTY[fv.INFO]),
        frames={
            "mappings": mappings, "conflicts": S.conflicts(mappings, policy), "unmapped": S.unmapped(mappings), "relations": S.relations(mappings, dictionary),
            "coverage": S.coverage(mappings), "stats": S.dictionary_stats(dictionary), "audit": S.audit_dictionary(dictionary),
        },
    )
    return report, outputs


def export_normalised(df: DataFrame, dictionary: DataFrame, path: str, row_id: str = "_row_id", fmt: str = "parquet", **options) -> Report:
    """Normalise one table and write it."""
    from terraloom.sources.sinks import write_table

    report, out = vocabulary_report({"table": df}, dictionary, row_id, **options)
    write_table(out["table"], path, fmt)
    return report
