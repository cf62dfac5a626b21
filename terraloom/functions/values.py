"""Scalar rules on single cells, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from terraloom import fixed_values as fv

# what a decimal literal looks like: digits may be grouped by single underscores
_DIGITS = r"\d+(?:_\d+)*"
NUMBER_PATTERN = rf"(?i)^[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)$"
PLAIN_NUMBER = r"^[+-]?[0-9]+(?:\.[0-9]+)?$"
NUMBER_HINT = r"[0-9]|(?i:inf|nan)"  # every match of NUMBER_PATTERN holds one of these
INTEGER_PATTERN = rf"^[+-]?{_DIGITS}$"
SEMVER_PATTERN = r"(?i)^V(\d+)\.(\d+)\.(\d+)$"


# every character that counts as white space at the ends of a cell
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not just blanks."""
    return F.btrim(text.cast("string"), F.lit(WHITE_SPACE))


def is_number_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def to_number(cell: Column, data_type: T.DataType | None = None) -> Column:
    """Cell -> double; null when it is not a number. Typed numeric columns are only widened."""
    if data_type is not None and is_number_type(data_type):
        return cell.cast("double")
    text = strip(cell)
    full = F.when(text.rlike(NUMBER_PATTERN), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    # the common form first; a word without a digit, inf or nan is neither trimmed nor matched
    return F.when(cell.rlike(PLAIN_NUMBER), cell.try_cast("double")).when(cell.rlike(NUMBER_HINT), full)


def finite(number: Column) -> Column:
    return F.abs(number) < F.lit(float("inf"))  # NaN sorts above infinity


def is_null_word(cell: Column, policy: str = "value") -> Column:
    """Null test under one of the four vocabularies; a float NaN is missing only for templates."""
    words = "|".join(w for w in fv.NULL_WORDS[policy] if w)
    blank = r"[\s\x1c-\x1f]*"
    return cell.isNull() | cell.cast("string").rlike(rf"(?iU)^{blank}(?:{words})?{blank}$" if words else rf"(?U)^{blank}$")


def has_value(cell: Column, data_type: T.DataType | None = None) -> Column:
    if data_type is not None and isinstance(data_type, (T.FloatType, T.DoubleType)):
        return cell.isNotNull() & ~F.isnan(cell)
    if data_type is not None and not isinstance(data_type, T.StringType):
        return cell.isNotNull()
    return ~is_null_word(cell, "value")


def missing_in_template(cell: Column, data_type: T.DataType | None = None) -> Column:
    if data_type is not None and isinstance(data_type, (T.FloatType, T.DoubleType)):
        return cell.isNull() | F.isnan(cell)
    if data_type is not None and not isinstance(data_type, T.StringType):
        return cell.isNull()
    return is_null_word(cell, "template")


def auto_number(cell: Column) -> Column:
    """Text -> STRUCT<kind, number, text>; an integer needs a literal without '.' and 'e'."""
    text = strip(cell)
    number = to_number(cell)
    integer = finite(number) & (number == F.floor(number)) & ~F.lower(text).rlike("[.e]")
    return F.when(
        text != "",
        F.struct(
            F.when(number.isNull(), "text").when(integer, "integer").otherwise("number").alias("kind"),
            number.alias("number"),
            F.when(number.isNull(), text).alias("text"),
        ),
    )


def staged(df: DataFrame, cell: str) -> DataFrame:
    """Add ``_t`` (trimmed text) and ``_n`` (its number) once, for rules that use them several times."""
    return df.withColumn("_t", strip(F.col(cell))).withColumn("_n", to_number(F.col(cell)))


def canonical_of(text: Column, number: Column) -> Column:
    """One text per distinct parsed value: '1', '01' and ' 1 ' agree, '1.0' differs from '1'."""
    integer = finite(number) & (number == F.floor(number)) & ~F.lower(text).rlike("[.e]")
    whole = F.when(F.abs(number) < 9e15, number.cast("long").cast("string")).otherwise(number.cast("string"))
    return F.when(number.isNull(), text).when(integer, whole).otherwise(number.cast("string"))


def value_type_of(number: Column) -> Column:
    return F.when(number.isNull(), "text").when(finite(number) & (number == F.floor(number)), "integer").otherwise("number")


def value_type(cell: Column) -> Column:
    """text / number / integer by parsed value, so '3.0' is an integer."""
    return F.when(cell.isNotNull(), value_type_of(to_number(cell)))


def decimal_places(literal: Column) -> Column:
    """Digits after the point; trailing zeros count only in exponent notation."""
    token = F.lower(strip(literal))
    mantissa, exponent = F.split_part(token, F.lit("e"), F.lit(1)), F.split_part(token, F.lit("e"), F.lit(2))

    def after_point(text: Column) -> Column:
        return F.when(F.instr(text, ".") > 0, F.substring_index(text, ".", -1)).otherwise("")

    scientific = F.when(
        exponent.rlike(INTEGER_PATTERN),
        F.greatest(F.lit(0), F.length(after_point(mantissa)) - F.replace(exponent, F.lit("_"), F.lit("")).try_cast("int")),
    ).otherwise(0)
    plain = F.length(F.regexp_replace(after_point(token), "0+$", ""))
    return F.when(F.instr(token, "e") > 0, scientific).otherwise(plain).cast("int")


def parse_ratio(text: Column, default: float = 0.05) -> Column:
    """'5%', '0.05' and '5' all give 0.05; anything unreadable gives the default."""
    token = F.replace(strip(text), F.lit("％"), F.lit("%"))
    percent = token.endswith("%")
    number = to_number(F.when(percent, F.expr("null")).otherwise(token))
    share = to_number(F.regexp_replace(token, "%$", "")) / 100
    ratio = F.when(percent, share).when(number > 1, number / 100).otherwise(number)
    return F.when(ratio.isNull(), default).otherwise(F.greatest(F.lit(0.0), F.least(ratio, F.lit(1.0))))


def human_size(size: Column) -> Column:
    b = size.cast("double")
    return (
        F.when(b < 1024, F.format_string("%d B", size.cast("long")))
        .when(b < 1024**2, F.format_string("%.1f KB", b / 1024))
        .when(b < 1024**3, F.format_string("%.1f MB", b / 1024**2))
        .otherwise(F.format_string("%.2f GB", b / 1024**3))
    )


def safe_stem(name: Column) -> Column:
    """Keep letters, digits, '-' and '_'; 'file' when nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    return F.when(kept == "", "file").otherwise(kept)


def safe_model_name(name: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(name, r"[^0-9A-Za-z_\-一-鿿]+", "_"), "^_+|_+$", "")
    return F.when(kept == "", "model").otherwise(kept)


def counter_from_id(identifier: Column) -> Column:
    """Trailing counter of four or more digits after a dash; 0 without one."""
    return F.coalesce(F.regexp_extract(identifier, r"-(\d{4,})$", 1).try_cast("long"), F.lit(0))


def semver_parts(number: Column) -> Column:
    """'V1.2.3' -> STRUCT<major, minor, patch>; null for any other form."""
    text = strip(number)
    part = lambda i: F.regexp_extract(text, SEMVER_PATTERN, i).try_cast("long")
    return F.when(
        text.rlike(SEMVER_PATTERN),
        F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")),
    )


def parse_timestamp(text: Column) -> Column:
    """ISO text with an optional Z; null (never the present moment) when unreadable."""
    return F.try_to_timestamp(F.regexp_replace(text.cast("string"), "Z$", "+00:00"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def contains_any(text: Column, words) -> Column:
    lowered = F.lower(text)
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word.lower())
    return found


def is_retryable(message: Column, words=fv.RETRYABLE_WORDS, never=fv.NON_RETRYABLE_WORDS) -> Column:
    """Retry by keyword; the deny list is read first."""
    return ~contains_any(message, never) & contains_any(message, words)


def comparison_role(path: Column) -> Column:
    """'before' / 'after' from the parent folder or marks in the stem; null when neither shows."""
    parent = F.lower(F.coalesce(F.try_element_at(F.split(path, r"[/\\]"), F.lit(-2)), F.lit("")))
    stem = F.lower(file_stem(path))
    before = parent.isin(*fv.BEFORE_PARENTS) | contains_any(stem, fv.BEFORE_TOKENS)
    after = parent.isin(*fv.AFTER_PARENTS) | contains_any(stem, fv.AFTER_TOKENS)
    return F.when(before, "before").when(after, "after")


def pair_key(name: Column) -> Column:
    """Stem without role words, separators folded to '_'."""
    stem = F.regexp_replace(F.lower(file_stem(name)), fv.PAIR_ROLE_PATTERN, "_")
    return F.regexp_replace(F.regexp_replace(stem, r"[_\-\s]+", "_"), "^_+|_+$", "")


def title_case(text: Column) -> Column:
    """Upper-case every letter that does not follow a letter, lower-case the rest."""
    size = F.length(text)
    letters = F.transform(
        F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>")),
        lambda i: F.when(
            (i > 1) & F.substr(text, F.greatest(i - 1, F.lit(1)), F.lit(1)).rlike(r"^\p{L}$"),
            F.lower(F.substr(text, i, F.lit(1))),
        ).otherwise(F.upper(F.substr(text, i, F.lit(1)))),
    )
    return F.array_join(letters, "")


def column_types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def q(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")
