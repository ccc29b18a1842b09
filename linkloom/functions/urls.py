"""URL parts, canonical forms and the 30 lexical features, as Spark column expressions.

Every expression is built once from a dialect, so the SQL twins that check the
engine come from the same definition of what a feature is, but run elsewhere.
URLs are inert text: nothing is resolved, requested or opened.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dialect:
    """How one SQL engine spells what the two do not have in common."""

    name: str

    def text(self, s: str) -> str:
        return ("r" if self.name == "spark" else "") + "'" + s + "'"

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, {self.text(pattern)}, '{by}'" + ("" if self.name == "spark" else ", 'g'") + ")"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} rlike {self.text(pattern)})" if self.name == "spark" else f"regexp_matches({x}, {self.text(pattern)})"

    def entropy(self, x: str) -> str:
        share = f"((length({x}) - length(replace({x}, c, ''))) / cast(length({x}) as double))"
        if self.name == "spark":
            return f"if(length({x}) = 0, 0D, aggregate(array_distinct(split({x}, '')), 0D, (a, c) -> a - {share} * log2({share})))"
        return f"CASE WHEN length({x}) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({x}, '')), lambda c: -{share} * log2({share}))) END"

    def sorted_keys(self, x: str) -> str:
        """The keys of a query string, sorted, each with a masked value."""
        if self.name == "spark":
            return f"array_join(array_sort(transform(filter(split({x}, '&'), p -> p <> ''), p -> concat(split_part(p, '=', 1), '=<V>'))), '&')"
        return f"array_to_string(list_sort(list_transform(list_filter(string_split({x}, '&'), lambda p: p <> ''), lambda p: split_part(p, '=', 1) || '=<V>')), '&')"

    def count_parts(self, x: str, by: str) -> str:
        if self.name == "spark":
            return f"size(filter(split({x}, '{by}'), p -> p <> ''))"
        return f"len(list_filter(string_split({x}, '{by}'), lambda p: p <> ''))"

    def long(self, x: str) -> str:
        return f"cast({x} as bigint)"


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")

#: The generic URI pattern (RFC 3986, appendix B), IPv4 octets and default ports.
URI = r"^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:[?]([^#]*))?(?:#(.*))?$"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Public suffixes of two labels; any other last label counts as a suffix. A part of the public list only.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za", "com.sg", "com.hk", "com.tw")
#: Watch-list words, and those that have a flag of their own.
TOKENS = ("login", "verify", "verification", "secure", "account", "update", "bank", "wallet", "password", "signin", "confirm", "payment", "bonus", "reward", "urgent")
TOKEN_FLAGS = ("login", "verify", "account", "secure", "update", "bank")
MAX_URL = 2000
#: Decimal digits of all scripts, and superscript and subscript ones.
DIGIT = "[\\p{Nd}²³¹⁰⁴-⁹₀-₉]"


def ip_v6(d: Dialect, x: str) -> str:
    """Eight groups of up to four hex digits, or fewer around one '::'; an IPv4 tail stands for two groups."""
    g = d.replace_all(x, f":{OCTET}(?:[.]{OCTET}){{3}}$", ":0:0")
    shape = " and ".join([
        d.matches(g, "^[0-9a-f:]*:[0-9a-f:]*$"), f"not {d.matches(g, '[0-9a-f]{5}|:::|^:[^:]|[^:]:$')}", f"length({g}) - length(replace({g}, '::', '')) <= 2",
    ])
    return f"(contains({x}, ':') and {shape} and CASE WHEN contains({g}, '::') THEN {d.count_parts(g, ':')} <= 7 ELSE {d.count_parts(g, ':')} = 8 END)"


def parts(d: Dialect, u: str = "url") -> list[tuple[str, str]]:
    """(name, expression) of each part; later ones use earlier ones. Broken hosts give empty parts."""
    host = f"regexp_extract(hostport, {d.text(r'^(\[[^\]]*\]|[^:\[\]]*)')}, 1)"
    suffixes = "|".join(s.replace(".", "[.]") for s in TWO_LABEL_SUFFIXES)
    return [
        ("scheme", f"lower(regexp_extract({u}, {d.text(URI)}, 1))"),
        ("netloc", f"regexp_extract({u}, {d.text(URI)}, 2)"),
        ("path", f"regexp_extract({u}, {d.text(URI)}, 3)"),
        ("query", f"regexp_extract({u}, {d.text(URI)}, 4)"),
        ("fragment", f"regexp_extract({u}, {d.text(URI)}, 5)"),
        ("userinfo", f"regexp_extract(netloc, {d.text('^(.*)@')}, 1)"),
        ("hostport", f"regexp_replace(netloc, {d.text('^.*@')}, '')"),
        ("host", f"lower(replace(replace({host}, '[', ''), ']', ''))"),
        ("port", f"regexp_extract(hostport, {d.text(':([0-9]+)$')}, 1)"),
        ("is_ip", f"({d.matches('host', f'^{OCTET}(?:[.]{OCTET}){{3}}$')} or {ip_v6(d, 'host')})"),
        ("suffixed", f"regexp_extract(host, {d.text(f'([^.]+[.](?:{suffixes}|[^.]+))$')}, 1)"),
        ("registered_domain", "CASE WHEN is_ip OR suffixed = '' THEN host ELSE suffixed END"),
    ]


def canonical(d: Dialect) -> str:
    """Lower-case scheme and host, no default port, '/' for an empty path; query and fragment as they are."""
    port = "CASE WHEN port = '' OR try_cast(port as bigint) = 0 OR (scheme = 'http' AND try_cast(port as bigint) = 80) OR (scheme = 'https' AND try_cast(port as bigint) = 443) THEN '' ELSE concat(':', cast(try_cast(port as bigint) as varchar(20))) END"
    return (
        "concat(CASE WHEN scheme = '' THEN '' ELSE concat(scheme, ':') END, CASE WHEN netloc = '' AND scheme = '' THEN '' ELSE '//' END, "
        f"CASE WHEN userinfo = '' THEN '' ELSE concat(userinfo, '@') END, host, {port}, CASE WHEN path = '' THEN '/' ELSE path END, "
        "CASE WHEN query = '' THEN '' ELSE concat('?', query) END, CASE WHEN fragment = '' THEN '' ELSE concat('#', fragment) END)"
    )


def template(d: Dialect) -> str:
    """The shape of path and query: digit runs and query values are masked, keys are sorted."""
    path = d.replace_all("lower(CASE WHEN path = '' THEN '/' ELSE path END)", r"[0-9]{3,}", "<N>")
    return f"concat({path}, CASE WHEN {d.sorted_keys('query')} = '' THEN '' ELSE concat('?', {d.sorted_keys('query')}) END)"


def nontrivial(template_column: str = "url_template") -> str:
    return f"({template_column} <> '/' AND (split_part({template_column}, '?', 1) NOT IN ('', '/') OR contains({template_column}, '?')))"


def shape_flags() -> list[tuple[str, str]]:
    root = "path IN ('', '/')"
    return [
        ("has_scheme", "cast(contains(url, '://') as int)"),
        ("is_https", "cast(scheme = 'https' as int)"),
        ("has_path", f"cast(NOT ({root}) as int)"),
        ("has_query", "cast(query <> '' as int)"),
        ("bare_domain", f"cast({root} AND query = '' AND fragment = '' as int)"),
    ]


def features(d: Dialect, u: str = "url") -> list[tuple[str, str]]:
    """(name, expression) of the 30 features, in their fixed order."""
    digits = f"(length({u}) - length({d.replace_all(u, DIGIT, '')}))"

    def count(c: str) -> str:
        return d.long(f"length({u}) - length(replace({u}, '{c}', ''))")

    def has(token: str) -> str:
        return f"cast(contains(lower({u}), '{token}') as bigint)"

    dots = "(length({0}) - length(replace({0}, '.', '')))"
    out = [
        ("url_length", d.long(f"length({u})")),
        ("url_hostname_length", d.long("length(host)")),
        ("url_path_length", d.long("length(path)")),
        ("url_query_length", d.long("length(query)")),
        ("url_dot_count", count(".")),
        ("url_subdomain_count", d.long(f"CASE WHEN is_ip THEN 0 ELSE {dots.format('host')} - {dots.format('registered_domain')} END")),
        ("url_hyphen_count", count("-")),
        ("url_digit_count", d.long(digits)),
        ("url_digit_ratio", f"CASE WHEN length({u}) = 0 THEN cast(0 as double) ELSE cast({digits} as double) / length({u}) END"),
        ("url_special_char_count", d.long(f"length({d.replace_all(u, r'[\p{L}\p{N}.:/]', '')})")),
        ("url_at_count", count("@")),
        ("url_question_count", count("?")),
        ("url_equals_count", count("=")),
        ("url_ampersand_count", count("&")),
        ("url_percent_count", count("%")),
        ("url_path_depth", d.long(d.count_parts("path", "/"))),
        ("url_query_param_count", d.long(d.count_parts("query", "&"))),
        ("url_has_https", "cast(scheme = 'https' as bigint)"),
        ("url_has_ip", "cast(is_ip as bigint)"),
        ("url_has_punycode", has("xn--")),
        ("url_has_nonstandard_port", "cast(CASE WHEN port = '' THEN false ELSE coalesce(try_cast(port as bigint), 65536) BETWEEN 0 AND 65535 AND try_cast(port as bigint) NOT IN (80, 443) END as bigint)"),
        ("url_has_double_slash_path", "cast(contains(path, '//') as bigint)"),
        ("url_entropy", d.entropy(u)),
        ("url_suspicious_token_count", d.long(" + ".join(has(t) for t in TOKENS))),
    ]
    return out + [(f"url_has_token_{t}", has(t)) for t in TOKEN_FLAGS]


FEATURES = [name for name, _ in features(SPARK)]
#: Counts and lengths that are modelled as log(1 + x).
LOGGED = [
    "url_length", "url_hostname_length", "url_path_length", "url_query_length", "url_dot_count", "url_subdomain_count", "url_hyphen_count", "url_digit_count", "url_special_char_count",
    "url_at_count", "url_question_count", "url_equals_count", "url_ampersand_count", "url_percent_count", "url_path_depth", "url_query_param_count", "url_suspicious_token_count",
]

#: The groups under which contributions are reported.
GROUPS = {
    "URL length and size": ["url_length", "url_hostname_length", "url_path_length", "url_query_length"],
    "Character mix": ["url_dot_count", "url_hyphen_count", "url_digit_count", "url_digit_ratio", "url_special_char_count", "url_at_count", "url_percent_count", "url_entropy"],
    "URL structure": ["url_subdomain_count", "url_path_depth", "url_query_param_count", "url_question_count", "url_equals_count", "url_ampersand_count", "url_has_double_slash_path"],
    "Connection and host type": ["url_has_https", "url_has_ip", "url_has_punycode", "url_has_nonstandard_port"],
    "Keywords": ["url_suspicious_token_count", *(f"url_has_token_{t}" for t in TOKEN_FLAGS)],
}


def triage(d: Dialect, payload: str = "payload") -> str:
    """'undecodable', 'non_url', 'too_long' or 'url': only plain http(s) URLs are analysed."""
    return (
        f"CASE WHEN {payload} IS NULL OR {payload} = '' THEN 'undecodable' "
        f"WHEN {d.matches(payload, r'[\s\p{C}\p{Z}]')} THEN 'non_url' "
        f"WHEN NOT {d.matches(f'lower({payload})', '^https?://')} THEN 'non_url' "
        f"WHEN length({payload}) > {MAX_URL} THEN 'too_long' "
        f"WHEN host = '' THEN 'non_url' ELSE 'url' END"
    )


def with_columns(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Adds each (name, expression); one that names an earlier one needs a projection of its own."""
    for name, expression in columns:
        df = df.withColumn(name, F.expr(expression.replace("varchar(20)", "string")))
    return df


def with_parts(df: DataFrame, u: str = "url") -> DataFrame:
    return with_columns(df, parts(SPARK, u))


def with_features(df: DataFrame, u: str = "url") -> DataFrame:
    """Adds the 30 features; needs the parts. A null url counts as empty."""
    return df.select("*", *(F.expr(e).alias(n) for n, e in features(SPARK, u)))


def sql_with(columns: list[tuple[str, str]], source: str) -> str:
    """A nested SELECT that adds each (name, expression) to `source`."""
    for name, expression in columns:
        source = f"(SELECT *, {expression} AS {name} FROM {source})"
    return source
