"""Text patterns of recognised pages: page numbers, headings, list items, masks, amounts, dates."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that decide what a line is. Those of a level or kind are joined, and what a lookahead would say is
# spelled out, as the same patterns have to run in an engine without lookahead.
PAGE_NUMBER = r"(?i)^(\d{1,4}|[ivxlcdm]{1,5}|[-–—]\s*\d{1,4}\s*[-–—]|第\s*\d+\s*页|Page\s+\d+|P\.?\s*\d+|\d{1,4}\s*/\s*\d{1,4})$"
HEADINGS = (
    (1, r"^(第[一二三四五六七八九十百千\d]+[章篇部]|Chapter\s+\d+|PART\s+[IVX]+)"),
    (2, r"^(第[一二三四五六七八九十百千\d]+[节条]|[一二三四五六七八九十]、|Section\s+\d+(\.\d+)?|[A-Z]\.\s)"),
    (3, r"^(\d+、|\d+\.([^\d]|$)|（[一二三四五六七八九十]）|\(\d+\))"),
    (4, r"^(（\d+）|\d+\.(\d\d|\d([^\d.]|\.[^\d]|\.?$))|\([a-z]\))"),
    (5, r"^(\d+\.\d+\.\d+|[ivx]+\.)"),
)
LIST_ITEMS = (
    ("numbered_arabic", r"^\s*(\d+)[\.、)\s]"),
    ("numbered_arabic", r"^\s*（(\d+)）"),
    ("numbered_arabic", r"^\s*\((\d+)\)"),
    ("numbered_chinese", r"^\s*([一二三四五六七八九十]+)[、\s]"),
    ("numbered_chinese", r"^\s*（([一二三四五六七八九十]+)）"),
    ("lettered_lower", r"^\s*([a-z])[\.\)、\s]"),
    ("lettered_lower", r"^\s*\(([a-z])\)"),
    ("lettered_upper", r"^\s*([A-Z])[\.\)、\s]"),
    ("lettered_upper", r"^\s*\(([A-Z])\)"),
    ("roman", r"^\s*([ivxlcdm]+)[\.\)、\s]"),
    ("bulleted", r"^\s*([-–—•·◦○●※★☆✓✔✗✘◆◇▶▷►▻])\s"),
    ("circled_number", r"^\s*([①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳])"),
)
TERMINAL = r"[。？！…\.\!\?\)」』】〗]$"
CONTINUES = r"^[a-z\x{4e00}-\x{9fff}，,、；;）\)」』】〗]"
CHAPTER = r"^(第[一二三四五六七八九十百千\d]+[章篇节条部]|[一二三四五六七八九十]、|\d+[\.、])"
NUMBERED_TITLE = r"^(第[一二三四五六七八九十百千\d]+[章篇节条部]|[一二三四五六七八九十]、|\d+[、.]|（[一二三四五六七八九十\d]）)"
GENERATED_HEADING = r"^(民事起诉状$|诉讼请求$|事实及理由$|此致$|第[一二三四五六七八九十]+[章节条款]|[一二三四五六七八九十]+[、.]|附表)"
#: What is taken out of a generated paragraph, and what stands for it, in this order (fixed values).
CLEANUPS = (
    (r"^[一二三四五六七八九十]+[、．.][^\n]*\n*", ""),
    (r"\*\*[^*]+\*\*\s*\n*", ""),
    (r"该机构具备法定鉴定资质[。，]?\s*", ""),
    (r"关于因果关系判定[、，]医疗过错认定及其参与度[，,]该鉴定意见未予明确界定[，,]故尚需结合其他证据或补充鉴定予以确认[。，]?\s*", ""),
    (r"但该鉴定意见未就[^。]*?(因果关系|过错|参与度)[^。]*?作出[^。]*?认定[。，]?\s*", ""),
    (r"鉴于[^。]*?尚待[^。]*?明确[，,]?\s*恳请[^。]*?[。，]?\s*", ""),
    (r"关于因果关系判定[、，][^。]*?(未予明确界定|未就[^。]*?作出明确认定)[^。]*?[。，]?\s*", ""),
    (r"本案在诉前调解阶段[，,]经[^，,]+?[与和][^，,]+?共同委托[，,]\s*", ""),
    (r"经原告[^，,]*?[与和]被告[^，,]*?共同委托[，,]\s*", ""),
    (r"\[\d{4}\]", ""),
    (r"^死者", "患者"),
    (r"\n{3,}", "\n\n"),
)
FAILED_MARK = r"\[(段落生成失败|生成失败)[^\]]*\]"
PENDING_MARK = r"\[待补充\]|（待补充）|\(待补充\)"
TABLE_SYMBOLS = r"[^\d.,;:()（）\-+%/℃㎡]"
#: The characters that TABLE_SYMBOLS leaves, which are looked up one by one, as the pattern takes some twenty times as long.
TABLE_CHARACTERS = "0123456789.,;:()（）-+%/℃㎡"
NUMBERS_ONLY = r"^[\d,.\-+/￥¥$%元角万]+$"
MONEY_WORDS = ("元", "万", "￥", "¥", "$", "合计", "总计", "金额")
AMOUNT = r"[：:\s]*[¥￥]?\s*([\d,]+\.?\d*)"


#: White space of the patterns, and the full-width space.
SPACES = " \t\n\x0b\f\r\u3000"


def stripped(c: Column) -> Column:
    """c without the white space around it, full-width spaces included."""
    return F.btrim(c, F.lit(SPACES))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """What the first match captures, or null without one. In a condition nullif would run the pattern twice."""
    return F.get(F.array_remove(F.array(F.regexp_extract(c, pattern, group)), F.lit("")), F.lit(0))


def double_or_null(c: Column) -> Column:
    """c as a double, or null. What begins as no number is never cast, as each failing cast raises and catches an exception."""
    return first_group(c, r"(?is)^([\x00-\x20]*[+-]?(?:\.?\d|nan|inf).*)").try_cast("double")


def iso_day(c: Column) -> Column:
    """The day that c is, as yyyy-MM-dd, or null; a day that its month does not have raises no exception."""
    last = F.last_day(F.concat(F.substring(c, 1, 8), F.lit("01")).try_cast("date")).cast("string")
    right = c.rlike(r"^(?!0000)\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])$") & ((F.substring(c, 9, 2) <= "28") | (c <= last))
    return F.when(right, c.try_cast("date"))


def contains_any(c: Column, keywords: Sequence[str]) -> Column:
    """Whether c contains one of the keywords. Many are one alternation, as a test for each makes generated methods too long to be compiled."""
    if len(keywords) > 3:
        return c.rlike("|".join(re.escape(k) for k in keywords))
    out = F.lit(False)
    for k in keywords:
        out = out | c.contains(k)
    return out


def is_page_number(c: Column, bare: bool = False) -> Column:
    """Whether a line is a page number; bare: it has no white space around it."""
    return (c if bare else stripped(c)).rlike(PAGE_NUMBER)


def heading_pattern_level(c: Column, bare: bool = False) -> Column:
    """1 to 5 by the first pattern table that the line starts with, or null; bare: it has no white space around it."""
    out, t = F.lit(None).cast("int"), c if bare else stripped(c)
    for level, pattern in reversed(HEADINGS):
        out = F.when(t.rlike(pattern), F.lit(level)).otherwise(out)
    return out


def heading_level(text: Column, font: Column, median: Column, bold: Column, centred: Column, top: Column) -> Column:
    """Heading level by pattern, else by font, else by place; moved up for bold at the top or the centre, down for plain small lines.

    A missing font is 0, as is a missing median; blank text has no level.
    """
    t, font, median = stripped(text), F.coalesce(font, F.lit(0.0)), F.coalesce(median, F.lit(0.0))
    bold, centred, top = (F.coalesce(x, F.lit(False)) for x in (bold, centred, top))
    large = (median > 0) & (font > median * 1.2)
    by_look = F.when(large & centred & (F.length(t) < 50), 2).when(large & bold, 3).when(top & (F.length(t) < 30), 1)
    none = 100
    base = F.coalesce(F.when(t != "", F.coalesce(heading_pattern_level(t), by_look)), F.lit(none))
    up = (top & bold).cast("int") + (centred & bold).cast("int")
    down = ((median > 0) & (font <= median) & ~bold & ~centred).cast("int")
    # the place of no level is outside the array, so that base stands once in the expression
    return F.get(F.array(*map(F.lit, (1, 2, 3, 4, 5, 5))), F.greatest(F.lit(1), base - up) + down - 1)


def list_item(c: Column) -> Column:
    """struct(type, marker, content) by the first pattern that matches at the start, or null."""
    t = stripped(c)
    out = F.lit(None).cast("struct<type:string,marker:string,content:string>")
    for kind, pattern in reversed(LIST_ITEMS):
        found = F.struct(F.lit(kind).alias("type"), F.regexp_extract(t, pattern, 1).alias("marker"), stripped(F.regexp_replace(t, pattern, "")).alias("content"))
        out = F.when(t.rlike(pattern), found).otherwise(out)
    return out


def list_type(bare: Column) -> Column:
    """The type of list_item() of a line without white space around it, or null; neither marker nor content is cut out."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(LIST_ITEMS):
        out = F.when(bare.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def ends_open(c: Column) -> Column:
    """Whether a line ends without a mark that closes a sentence, and is no bare page number."""
    t = stripped(c)
    return (t != "") & ~t.rlike(r"^\d{1,4}$") & ~t.rlike(TERMINAL)


def continues_line(c: Column) -> Column:
    """Whether a line can carry on the one before: a small letter, any CJK character or closing punctuation first, and no chapter heading."""
    return stripped(c).rlike(CONTINUES) & ~stripped(c).rlike(CHAPTER)


def dense_in_symbols(c: Column) -> Column:
    """Whether more than a quarter of a line's characters are digits or table symbols."""
    others = F.translate(c, TABLE_CHARACTERS, "")
    return (F.length(c) - F.length(others)) / F.greatest(F.length(c), F.lit(1)) > 0.25


def is_amount_line(c: Column) -> Column:
    return stripped(c).rlike(NUMBERS_ONLY) | contains_any(c, MONEY_WORDS)


def masked_id(c: Column) -> Column:
    """The first six and last four characters around four stars; shorter than ten stays."""
    return F.when(F.length(c) < 10, c).otherwise(F.concat(F.substring(c, 1, 6), F.lit("****"), F.right(c, F.lit(4))))


def receipt_tail(filename: Column) -> Column:
    """The last four digits of a file name that has four or more; else empty."""
    digits = F.regexp_replace(filename, r"[^0-9]", "")
    return F.when(F.length(digits) >= 4, F.right(digits, F.lit(4))).otherwise(F.lit(""))


def safe_double(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.regexp_replace(stripped(c), ",", "").try_cast("double"), F.lit(default))


def decimal_amount(c: Column) -> Column:
    return F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def normalized_date(c: Column) -> Column:
    """Dates in several spellings as 年月日, without leading zeros; O counts as 0; anything else stays as it is."""
    s = F.translate(stripped(c), "OｏＯ", "000")
    full = (r"^(\d{4})年(\d{1,2})月(\d{1,2})日", r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})", r"^(\d{4})(\d{2})(\d{2})$")
    number = lambda p, g: F.regexp_extract(s, p, g).try_cast("int").cast("string")
    out = s
    out = F.when(s.rlike(r"^\d{4}年?$"), F.concat(F.substring(s, 1, 4), F.lit("年"))).otherwise(out)
    month = r"^(\d{4})年(\d{1,2})月$"
    out = F.when(s.rlike(month), F.concat(F.substring(s, 1, 4), F.lit("年"), number(month, 2), F.lit("月"))).otherwise(out)
    for p in reversed(full):
        out = F.when(s.rlike(p), F.concat(F.substring(s, 1, 4), F.lit("年"), number(p, 2), F.lit("月"), number(p, 3), F.lit("日"))).otherwise(out)
    return out


def parsed_date(c: Column) -> Column:
    """The date that normalized_date reads, the first of the month or year where the rest is missing; null otherwise."""
    n = normalized_date(c)
    p = r"^(\d{4})年(?:(\d{1,2})月(?:(\d{1,2})日)?)?$"
    part = lambda g: F.coalesce(F.regexp_extract(n, p, g).try_cast("int"), F.lit(1))
    return F.when(n.rlike(p), F.try_to_date(F.format_string("%04d-%02d-%02d", part(1), part(2), part(3)), "yyyy-MM-dd"))


def first_date(c: Column) -> Column:
    """The first date with year, month and day anywhere in a text, as ISO text; null without one."""
    p = r"(\d{4})\s*[年/\-.]\s*(\d{1,2})\s*[月/\-.]\s*(\d{1,2})"
    two = lambda g: F.lpad(F.regexp_extract(c, p, g), 2, "0")
    return F.when(c.rlike(p), F.concat_ws("-", F.regexp_extract(c, p, 1), two(2), two(3)))


def stay_days(c: Column) -> Column:
    """Days in hospital as stated, else between the first and last date if 1 to 365, else 0."""
    said = F.coalesce(*[first_group(c, p).try_cast("int") for p in (r"住院\s*(\d+)\s*天", r"实际住院\s*(\d+)\s*天", r"共\s*住\s*院\s*(\d+)\s*天", r"住院天数[：:\s]*(\d+)")])
    day = r"\d{4}\s*年\s*\d{1,2}\s*月\s*\d{1,2}\s*日"
    dates = F.regexp_extract_all(c, F.lit(day), F.lit(0))
    at = lambda i: F.try_to_date(F.regexp_replace(F.try_element_at(dates, F.lit(i)), r"\s", ""), "yyyy年M月d日")
    between = F.abs(F.date_diff(at(-1), at(1)))
    return F.coalesce(said, F.when((F.size(dates) >= 2) & between.between(1, 365), between), F.lit(0))


def unfenced(c: Column) -> Column:
    """Model output without the code fence around it and without empty lines; empty if what is left is a JSON object or array as a whole."""
    plain = stripped(c)
    body = F.when(c.contains("```"), F.regexp_replace(F.regexp_replace(plain, r"^```(?:json|JSON)?\s*", ""), r"\s*```$", "")).otherwise(plain)
    json = (body.startswith("{") & body.endswith("}")) | (body.startswith("[") & body.endswith("]"))
    return F.when(json, F.lit("")).when(c.contains("\n\n"), stripped(F.regexp_replace(body, r"\n{2,}", "\n"))).otherwise(stripped(body))


def without_control_characters(c: Column) -> Column:
    """c without characters that XML does not allow."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def is_generated_heading(c: Column) -> Column:
    """Whether a line of a generated document is a heading."""
    return stripped(c).rlike(GENERATED_HEADING)


def cleaned_paragraph(c: Column) -> Column:
    """A generated paragraph without its number, lead-ins, and sentences that judge or guess."""
    for pattern, new in CLEANUPS:
        c = F.regexp_replace(c, pattern, new)
    return stripped(c)


def chinese_year(c: Column) -> Column:
    return F.translate(c, "0123456789", "〇一二三四五六七八九")


def ethnicity(c: Column) -> Column:
    """The name of an ethnic group with 族 at its end; empty stays empty."""
    name = stripped(c)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).when(name.endswith("族"), name).otherwise(F.concat(name, F.lit("族")))


def is_private_host(host: Column) -> Column:
    """Whether a dotted-quad host lies in a network that callbacks must not reach, or is a local name."""
    quads = [F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$", g).try_cast("long") for g in range(1, 5)]
    number = quads[0] * 16777216 + quads[1] * 65536 + quads[2] * 256 + quads[3]
    out = F.lower(host).isin("localhost", "::1") | F.lower(host).rlike("^(f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):")
    for net, bits in PRIVATE_NETWORKS:
        a, b, c, d = map(int, net.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        out = out | F.coalesce(number.between(low, low + 2 ** (32 - bits) - 1), F.lit(False))
    return out


#: Networks that are not reachable from outside.
PRIVATE_NETWORKS = (("127.0.0.0", 8), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16), ("0.0.0.0", 8), ("100.64.0.0", 10), ("198.18.0.0", 15))
