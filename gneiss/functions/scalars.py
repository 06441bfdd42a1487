"""Column expressions shared by the operators. All are native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gneiss.schemas import SEVERITIES


def severity_rank(severity: Column | str) -> Column:
    """0 for critical to 4 for info; -1 for anything else, which therefore passes every threshold."""
    severity = F.col(severity) if isinstance(severity, str) else severity
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity) - 1, F.lit(-1)).cast("int")


def rank_of(severity: str) -> int:
    return SEVERITIES.index(severity) if severity in SEVERITIES else -1


def line_bucket(line: Column | str) -> Column:
    """Lines in steps of five: 5 to 9 agree, 4 and 5 don't."""
    line = F.col(line) if isinstance(line, str) else line
    return (F.floor(line / 5) * 5).cast("int")


def fingerprint(rule: str = "rule", file: str = "file", line: str = "line") -> Column:
    return F.concat_ws(":", rule, file, line_bucket(line).cast("string"))


def js_trim(text: Column | str) -> Column:
    """Trims all Unicode white space, as JavaScript does."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+", ""), r"(?U)[\s\x{FEFF}]+$", "")


def mask_secret(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.length(value) <= 12, F.concat(F.substring(value, 1, 3), F.lit("***"))).otherwise(F.concat(F.substring(value, 1, 6), F.lit("..."), F.substring(value, -4, 4), F.lit(" (masked)")))


def uri_encode(text: Column | str) -> Column:
    """encodeURIComponent: spaces as %20, and !'()* as they are."""
    out = F.url_encode(text)
    for code, plain in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, code, plain)
    return out


def purl(ecosystem: str = "ecosystem", name: str = "name", version: str = "version") -> Column:
    return F.concat(F.lit("pkg:"), F.lower(ecosystem), F.lit("/"), uri_encode(name), F.lit("@"), F.col(version))


def number_prefix(text: Column | str) -> Column:
    """The number that a text starts with, else null."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))", 1).try_cast("double")


def cvss_band(score: Column) -> Column:
    return F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def advisory_severity(severity: str = "severity", fallback: str = "db_severity") -> Column:
    """From the first CVSS_V3 entry (text without a number: low), else the database's own word, else high."""
    v3 = F.filter(F.col(severity), lambda s: s["type"] == "CVSS_V3")
    own = F.lower(fallback)
    named = F.when(own.isin("critical", "high", "medium", "low"), own).when(own == "moderate", "medium")
    return F.when(F.size(v3) > 0, F.coalesce(cvss_band(number_prefix(F.element_at(v3, 1)["score"])), F.lit("low"))).otherwise(F.coalesce(named, F.lit("high")))


#: Licenses by what their upper-case name holds, permissive ones first; then common families.
PERMISSIVE = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "CC0-1.0", "Unlicense", "WTFPL", "Zlib", "BlueOak-1.0.0", "PSF-2.0")
COPYLEFT = ("GPL-2.0", "GPL-3.0", "AGPL-3.0", "LGPL-2.1", "LGPL-3.0", "EUPL-1.2", "MPL-2.0", "CPAL-1.0", "OSL-3.0")
PERMISSIVE_FAMILIES, COPYLEFT_FAMILIES = ("MIT", "BSD", "ISC", "APACHE"), ("GPL",)


def license_class(license: Column | str) -> Column:
    """ok, copyleft or unknown; a dual license with a permissive part is ok."""
    upper = F.upper(license)

    def has(names: tuple[str, ...]) -> Column:
        return F.exists(F.array(*(F.lit(n.upper()) for n in names)), lambda n: F.contains(upper, n))

    out = F.when(upper.isNull() | upper.isin("", "UNKNOWN", "UNLICENSED"), "unknown")
    return out.when(has(PERMISSIVE), "ok").when(has(COPYLEFT), "copyleft").when(has(PERMISSIVE_FAMILIES), "ok").when(has(COPYLEFT_FAMILIES), "copyleft").otherwise("unknown")


def entropy(text: Column | str) -> Column:
    """Shannon entropy of a text's characters in bits."""
    text = F.col(text) if isinstance(text, str) else text
    letters = F.split(text, "")
    n = F.size(letters).cast("double")
    shares = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda d: d == c)) / n)
    return F.when(F.length(text) > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(F.lit(0.0))


def fnv1a(text: Column | str) -> Column:
    """FNV-1a of a text's characters in 32 bits, as eight hexadecimal digits."""
    text = F.col(text) if isinstance(text, str) else text
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    h = F.aggregate(letters, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(0x01000193).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def escape_sentinels(text: Column | str) -> Column:
    """Untrusted text that can't close a prompt's sentinel tags."""
    return F.regexp_replace(text, r"<(/?)(untrusted[^>]*)>", "&lt;$1$2&gt;")


def match_line(content: Column, regex: str) -> Column:
    """1-based line of the first match in a whole text; null without one."""
    at = F.regexp_instr(content, F.lit(regex))
    return F.when(at > 0, F.size(F.split(F.substring(content, F.lit(1), at - 1), "\n")))
