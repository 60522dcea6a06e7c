"""Name normalisation and name-derived attributes as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import vocab

# Punctuation that loses its surrounding blanks, in this order.
TIGHT_PUNCTUATION = [":", "：", ",", "，", "(", ")", "（", "）", "[", "]",
                     "【", "】", "{", "}", "-", "—", "·", ".", "。"]

# Sheet-name tokens that never name an industry.
NON_INDUSTRY_TOKENS = ["日度", "周度", "月度", "季度", "年度", "Wind", "wind", "同花顺",
                       "TongHuaShun", "tonghuashun", "Mysteel", "mysteel", "Myteel", "myteel"]

# Sheet frequency text and its feed type.
SHEET_FEEDS = {"日度": "daily", "周度": "weekly", "旬度": "dekad", "月度": "monthly_predictor"}

# Frequency text found anywhere in a sheet name, in this order.
SHEET_FREQUENCIES = [("周度", "weekly"), ("月度", "monthly"), ("日度", "daily"),
                     ("旬度", "ten_day"), ("季度", "quarterly"), ("年度", "yearly")]

_HALF = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
_FULL = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"


@F.pandas_udf(T.StringType())
def _nfkc(names: pd.Series) -> pd.Series:
    return names.map(lambda s: unicodedata.normalize("NFKC", s), na_action="ignore")


def half_width(c: Column) -> Column:
    """Full-width ASCII and the ideographic blank to their plain forms."""
    return F.translate(c, _FULL, _HALF)


# Characters whose compatibility form the full-width block alone gives.
_PLAIN = "[^\\x00-\\x7F\\u00B7\\u2014\\u3000-\\u3002\\u3010\\u3011\\u4E00-\\u9FFF\\uFF01-\\uFF5E]"


# Blanks next to a mark: one goes on either side of it.
_MARKS = "[" + "".join("\\" + mark for mark in TIGHT_PUNCTUATION) + "]"
_TIGHT = f" (?={_MARKS})|(?<={_MARKS}) "
# White space that is not a single blank.
_LOOSE = r"[\t\n\x0B\f\r]\s*| \s+"
_SPACE = " \t\n\x0b\f\r"


def _once(c: Column, use) -> Column:
    """``use(c)`` with ``c`` computed once per row, however often it is used."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _fold(c: Column, exact: bool) -> Column:
    """Unicode compatibility form.  Texts of plain characters stay inside Spark;
    the others go through Arrow, unless ``exact`` is off.  Only texts that have
    full-width characters are translated."""
    ascii_only = F.octet_length(c) == F.char_length(c)
    wide = F.when(ascii_only, c).when(c.rlike("[\\u3000\\uFF01-\\uFF5E]"), half_width(c)).otherwise(c)
    return F.coalesce(_nfkc(F.when(~ascii_only & c.rlike(_PLAIN), c)), wide) if exact else wide


def _lower_if_ascii(c: Column) -> Column:
    return _once(c, lambda x: F.when(x.rlike(r"[\x00-\x7F]"), F.lower(x)).otherwise(x))


def _blank_if_missing(raw: Column, cleaned: Column) -> Column:
    return F.when(raw.isNull() | (raw == ""), F.lit("")).otherwise(cleaned)


def normalize_text(raw: Column, to_lower: bool = True, exact: bool = True) -> Column:
    """Fold, trim, drop one blank on either side of punctuation, squeeze, lower."""
    c = F.trim(F.regexp_replace(F.regexp_replace(_fold(raw, exact), _TIGHT, ""), _LOOSE, " "))
    return _blank_if_missing(raw, _lower_if_ascii(c) if to_lower else c)


def normalize_variable(raw: Column, drop_blanks: bool = False, exact: bool = True) -> Column:
    """Fold, trim, lower; optionally without any blank."""
    c = _lower_if_ascii(F.btrim(_fold(raw, exact), F.lit(_SPACE)))
    return _blank_if_missing(raw, F.replace(c, F.lit(" "), F.lit("")) if drop_blanks else c)


def normalize_heading(raw: Column) -> Column:
    """Half-width brackets and colon, ``: `` after each colon, squeezed blanks."""
    c = F.translate(raw, "（）：　", "(): ")
    c = F.regexp_replace(c, r":(?!\s)", ": ")
    return F.trim(F.regexp_replace(F.trim(c), r"\s+", " "))


def industry_from_source(source: Column) -> Column:
    """First token of the sheet name that is not a frequency or vendor word."""
    parts = F.split(source, r"\|")
    sheet = F.trim(F.when(F.size(parts) >= 2, parts[1]).otherwise(parts[0]))
    tokens = F.filter(F.split(sheet, r"[_\-\s]+"), lambda t: t != "")
    kept = F.filter(tokens, lambda t: ~t.isin(NON_INDUSTRY_TOKENS))
    return F.coalesce(F.get(kept, F.lit(0)), F.get(tokens, F.lit(0)),
                      F.when(sheet != "", sheet), F.lit("未知"))


def sheet_info(sheet: Column, target_sheet: str) -> Column:
    """Struct of industry, feed type and source read from ``industry_freq_source``."""
    parts = F.split(sheet, "_")
    is_target = F.lower(sheet) == target_sheet.lower()
    target_industry = F.trim(F.replace(parts[0], F.lit("-月度"), F.lit("")))
    feed = F.lit(None).cast("string")
    for word, name in SHEET_FEEDS.items():
        feed = F.when(F.trim(F.get(parts, F.lit(1))) == word, F.lit(name)).otherwise(feed)
    source = F.when(F.size(parts) >= 3, F.trim(F.array_join(F.slice(parts, F.lit(3), F.size(parts)), "_")))
    return F.struct(
        F.when(is_target, F.when(target_industry == "", F.lit("Macro")).otherwise(target_industry))
        .when(F.size(parts) >= 2, F.trim(parts[0])).alias("industry"),
        F.when(is_target, F.lit("monthly_target")).otherwise(feed).alias("feed"),
        F.when(~is_target, source).alias("source"))


def sheet_frequency(sheet: Column) -> Column:
    """Frequency named anywhere in the sheet name."""
    out = F.lit(None).cast("string")
    for word, name in reversed(SHEET_FREQUENCIES):
        out = F.when(sheet.contains(word), F.lit(name)).otherwise(out)
    return out


def frequency_code(text: Column) -> Column:
    """One-letter frequency from dictionary text, first matching word wins."""
    out = F.lit(None).cast("string")
    for word, code in reversed(vocab.FREQ_WORDS + vocab.FREQ_WORDS_EN):
        out = F.when(F.lower(text).contains(word), F.lit(code)).otherwise(out)
    return out


def display_name(name: Column) -> Column:
    """Group prefix removed; export groups read as industries."""
    # The two group prefixes and the suffix.
    return (F.when(name.startswith("出口依赖_"),
                   F.concat(F.replace(name, F.lit("出口依赖_"), F.lit("")), F.lit("行业")))
            .when(name.startswith("上中下游_"), F.replace(name, F.lit("上中下游_"), F.lit("")))
            .otherwise(name))


def short_indicator(name: Column) -> Column:
    """Indicator without its leading dataset name and trailing growth label."""
    # The dataset name and the label.
    c = F.regexp_replace(name, "^规模以上工业增加值:", "")
    return F.when(c.endswith(":当月同比"), F.replace(c, F.lit(":当月同比"), F.lit(""))).otherwise(c)


def strip_separators(name: Column) -> Column:
    """Industry name without separators and particles, for loose matching."""
    return F.translate(name, "、，。及和的 　", "")


def stationarity_label(answer: Column) -> Column:
    return F.when(answer == "是", "平稳").when(answer == "否", "非平稳").otherwise(answer)


def sign_class(v: Column) -> Column:
    """Display class of a number: positive, negative, or none."""
    return F.when(v > 0, "positive").when(v < 0, "negative")


def fixed_decimals(v: Column, places: int = 2) -> Column:
    """Number with ``places`` decimals, or a dash for a missing one.

    A negative number keeps its sign where it rounds to zero."""
    shown = F.format_string(f"%.{places}f", F.abs(F.round(v, places)))
    return F.when(v.isNull() | F.isnan(v), F.lit("-")).otherwise(F.concat(F.when(v < 0, "-").otherwise(""), shown))


def contains_any(term: str, *cols: Column) -> Column:
    """Case-insensitive search over several columns."""
    wanted = F.lit(term.lower())
    hit = F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.lower(c.cast("string")).contains(wanted), F.lit(False))
    return hit
