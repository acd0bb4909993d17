"""URL, domain, slug and address expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fragments import let, q
from .text import blank_to_null, trim_ws

# Schemes never followed, asset endings, tracking parameter name prefixes.
SKIP_SCHEMES = r"(?i)^(mailto|tel|javascript|data|sms|ftp):"
ASSET_PATH = (
    r"(?i)\.(jpe?g|png|gif|webp|avif|svg|ico|css|js|mjs|json|xml|pdf|zip|gz|mp4|mp3|woff2?|ttf|eot)$"
)
TRACKING_PARAM = r"(?i)^(utm_|fbclid|gclid|msclkid|ref|mc_cid|mc_eid)"

_BAD_HOST = r"[\s<>^|%\\]"
_AUTHORITY = r"(?i)^[a-z][a-z0-9+.\-]*:[/\\]{2,}([^/\\?#]*)"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority_of(url: Column) -> Column:
    """Everything between the slashes and the path, credentials included; '' when absent."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def _host_port(url: Column) -> Column:
    return F.lower(F.regexp_replace(authority_of(url), r"^.*@", ""))


def url_host(url: Column) -> Column:
    """Host with its port, default ports dropped; '' when the text is no http(s) URL."""
    hp = _host_port(url)
    return (
        F.when(scheme_of(url) == "https", F.regexp_replace(hp, r":(443)?$", ""))
        .when(scheme_of(url) == "http", F.regexp_replace(hp, r":(80)?$", ""))
        .otherwise(F.lit(""))
    )


def url_hostname(url: Column) -> Column:
    """Host without port; '' when the text is no http(s) URL or the host is malformed."""
    host = F.regexp_replace(_host_port(url), r":[0-9]*$", "")
    ok = scheme_of(url).isin("http", "https") & ~host.rlike(_BAD_HOST) & (host != "")
    return F.when(ok, host).otherwise(F.lit(""))


def url_origin(url: Column) -> Column:
    return F.when(url_hostname(url) != "", F.concat(scheme_of(url), F.lit("://"), url_host(url)))


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"(?i)^www\.", "")


def domain_of(url: Column) -> Column:
    """Lower-case host without ``www.``; '' for anything that is not a URL."""
    return strip_www(url_hostname(url))


def domain_sql(url: str) -> str:
    """``domain_of`` as SQL text, for use inside lambdas and SQL functions; the same rules, malformed hosts included."""
    authority = f"regexp_extract({url}, {q(r'(?i)^https?:[/\\]{2,}([^/\\?#]*)')}, 1)"
    host = f"lower(regexp_replace(regexp_replace({authority}, '^.*@', ''), ':[0-9]*$', ''))"
    return let(host, "dh", f"if(dh RLIKE {q(_BAD_HOST)}, '', regexp_replace(dh, '^www[.]', ''))")


def domain_matches(candidate: Column, target: Column) -> Column:
    """Equal to the target, or a subdomain of it; an empty side never matches."""
    c, t = F.lower(strip_www(candidate)), F.lower(strip_www(target))
    hit = (c == t) | F.endswith(c, F.concat(F.lit("."), t))
    return F.coalesce((c != "") & (t != "") & hit, F.lit(False))


def domain_suffixes(domain: Column) -> Column:
    """All dot suffixes of a host: ``a.b.c`` gives ``[a.b.c, b.c, c]``. Turns suffix tests into an equi join."""
    parts = F.split(domain, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."),
    )


def normalise_target(raw: Column) -> Column:
    """Trim and add a scheme; NULL for blank input."""
    t = trim_ws(raw)
    return F.when(t == "", F.lit(None).cast("string")).when(
        t.rlike(r"(?i)^https?://"), t
    ).otherwise(F.concat(F.lit("https://"), t))


def parse_site_url(raw: Column) -> Column:
    """``struct(origin, domain)`` of user input."""
    full = normalise_target(raw)
    return F.struct(url_origin(full).alias("origin"), domain_of(full).alias("domain"))


def clean_domain(raw: Column) -> Column:
    d = F.regexp_replace(trim_ws(raw), r"(?i)^https?://", "")
    return blank_to_null(F.lower(F.regexp_replace(strip_www(d), r"/.*$", "")))


def host_of(origin: Column) -> Column:
    return F.when(url_hostname(origin) != "", url_host(origin)).otherwise(origin)


def citation_url_key(url: Column) -> Column:
    """Key under which two citations of one page are the same."""
    return F.regexp_replace(F.regexp_replace(url, r"[#?][^\n\r]*$", ""), r"/$", "")


def slugify(raw: Column, max_len: int = 50, fallback: str = "report") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(blank_to_null(F.substring(s, 1, max_len)), F.lit(fallback))


# --- addresses -------------------------------------------------------------------------------

_IPV4 = r"^(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"


def is_ipv4(x: Column) -> Column:
    return F.coalesce(x.rlike(_IPV4), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as one number; NULL when it is not one."""
    octet = F.split(ip, r"\.", -1)
    return F.when(
        is_ipv4(ip),
        sum((F.get(octet, i).try_cast("bigint") * (256 ** (3 - i)) for i in range(1, 4)),
            F.get(octet, 0).try_cast("bigint") * 256**3),
    )


def cidr_contains(ip: Column, cidr: Column) -> Column:
    """IPv4 containment; anything malformed is outside."""
    net = ipv4_number(F.split_part(cidr, F.lit("/"), F.lit(1)))
    bits_text = F.split_part(cidr, F.lit("/"), F.lit(2))
    bits = F.when(bits_text.rlike("^[0-9]{1,2}$"), bits_text.try_cast("int"))
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("bigint")
    inside = (ipv4_number(ip) - F.pmod(ipv4_number(ip), size)) == (net - F.pmod(net, size))
    return F.coalesce(F.when(bits.between(0, 32), inside), F.lit(False))


# IPv4 ranges that are not public.
PRIVATE_RANGES = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16",
    "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/3",
]


def is_private_ip(host: Column) -> Column:
    """Loopback, private, link-local, carrier or multicast address, IPv6 forms included."""
    bare = F.regexp_replace(F.lower(host), r"^\[|\]$", "")
    v4 = F.regexp_replace(bare, r"^::ffff:(?=[0-9.]+$)", "")
    private4 = F.lit(False)
    for block in PRIVATE_RANGES:
        private4 = private4 | cidr_contains(v4, F.lit(block))
    v6 = F.contains(bare, F.lit(":")) & (bare.isin("::", "::1") | bare.rlike("^(fe80|fc|fd)"))
    return F.coalesce(private4 | v6, F.lit(False))


def is_public_url(url: Column) -> Column:
    """http(s), no credentials, no local name, no private literal address."""
    host = url_hostname(url)
    return F.coalesce(
        (host != "")
        & ~F.contains(authority_of(url), F.lit("@"))
        & (host != "localhost")
        & ~host.endswith(".localhost")
        & ~is_private_ip(host),
        F.lit(False),
    )
