"""URL columns. Three normal forms on purpose: what counts as the same page differs between dedup, import and citation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
RFC3986 = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
BARE_URL = r"https?://(?:[^\s<>\]\(\)\"']+|\([^\s<>\]\(\)\"']*\))+"
IMAGE_LINK = r"!\[[^\]]*\]\((" + BARE_URL + r")(?:\s+[^\)]*)?\)"
TRAILING = ".,;:!?"
VIDEO_HOSTS = ("youtube.com", "www.youtube.com", "m.youtube.com", "music.youtube.com", "youtu.be")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used: as the variable of a function over one element."""
    return F.transform(F.array(value), use)[0]


def part(url: Column | str, k: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty where absent."""
    return F.regexp_extract(_col(url), RFC3986, k)


def _joined(url: Column, path: Column, fragment: bool) -> Column:
    some = lambda c, before, after: F.when(c != "", F.concat(F.lit(before), c, F.lit(after))).otherwise("")
    out = [some(F.lower(part(url, 1)), "", ":"), some(F.lower(part(url, 2)), "//", ""), path, some(part(url, 4), "?", "")]
    return F.concat(*out, *([some(part(url, 5), "#", "")] if fragment else []))


def dedup_key(url: Column | str) -> Column:
    """Lower-case scheme and host, no fragment; a trailing slash is kept."""
    return _joined(_col(url), part(url, 3), False)


def import_key(url: Column | str) -> Column:
    """dedup_key without the path's trailing slashes."""
    return _joined(_col(url), F.regexp_replace(part(url, 3), "/+$", ""), False)


def citation_key(url: Column | str) -> Column:
    """Trailing punctuation off, lower-case scheme and host, no trailing slashes; the fragment is kept."""
    u = F.regexp_replace(_col(url), "[.,;:!?]+$", "")
    return _joined(u, F.regexp_replace(part(u, 3), "/+$", ""), True)


def host(url: Column | str) -> Column:
    """Lower case, without user and port."""
    return F.regexp_replace(F.regexp_replace(F.lower(part(url, 2)), "^.*@", ""), ":[0-9]*$", "")


def on_host(url: Column | str, name: str, subdomains: bool = True) -> Column:
    h = host(url)
    return (h == name) | h.endswith("." + name) if subdomains else h == name


def video_id(url: Column | str) -> Column:
    """Of a video URL: from the short host's path, a shorts/embed/live/v path, or ``?v=``; null otherwise."""
    h, path = host(url), F.regexp_replace(part(url, 3), "^/+", "")
    found = F.when(h == "youtu.be", F.regexp_extract(path, "^([^/]*)", 1)).otherwise(
        F.coalesce(F.nullif(F.regexp_extract(path, "(?i)^(?:shorts|embed|live|v)/([^/]*)", 1), F.lit("")), F.regexp_extract(part(url, 4), "(?:^|&)v=([^&]+)", 1))
    )
    return F.when(h.isin(*VIDEO_HOSTS) & found.rlike("^[a-zA-Z0-9_-]+$"), found)


def bare_urls(text: Column | str) -> Column:
    """All URLs in a text, as they stand there."""
    return F.regexp_extract_all(_col(text), F.lit("(" + BARE_URL + ")"), 1)


def image_urls(text: Column | str) -> Column:
    """URLs of a text's images."""
    return F.regexp_extract_all(_col(text), F.lit(IMAGE_LINK), 1)


# Address ranges that aren't public, and those within them that are.
PRIVATE4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
PUBLIC4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE6 = ("::/127", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10")
PUBLIC6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
LOCAL_NAMES = ("localhost", "localhost.localdomain")


def literal_host(url: Column | str) -> Column:
    """The host as addresses are read: lower case, without user, port, brackets, zone and dots after it."""
    h = F.regexp_replace(F.btrim(F.lower(part(_col(url), 2))), "^.*@", "")
    named = lambda x: F.regexp_replace(F.regexp_replace(x, ":[0-9]*$", ""), r"\.+$", "")
    return let(h, lambda x: F.when(x.startswith("["), F.regexp_extract(x, r"^\[([^\]%]*)", 1)).otherwise(named(x)))


def ipv4_number(host: Column | str) -> Column:
    """An IPv4 address as a number, in any form that the socket library reads: one to four parts, each decimal, octal or hexadecimal, the last one filling what is left; else null."""
    one = "(?:0x[0-9a-f]+|0[0-7]*|[1-9][0-9]*)"
    digits = lambda p, base: F.conv(p, base, 10).try_cast("long")
    value = lambda p: F.when(p.startswith("0x"), digits(F.substring(p, 3, 64), 16)).when(p.startswith("0"), digits(p, 8)).otherwise(digits(p, 10))

    def number(p: Column) -> Column:
        return F.when(F.length(F.regexp_replace(p, "^0x?0*", "")) <= 12, value(p))  # beyond, it is too large in any base

    def whole(numbers: Column) -> Column:
        n = F.size(numbers)
        room = F.element_at(F.array(*[F.lit(1 << (8 * (4 - k))).cast("long") for k in range(4)]), n)
        fits = F.forall(F.slice(numbers, 1, n - 1), lambda x: F.coalesce(x < 256, F.lit(False))) & (F.element_at(numbers, -1) < room)
        high = F.aggregate(F.slice(numbers, 1, n - 1), F.lit(0).cast("long"), lambda a, x: a * 256 + x)
        return F.when(fits, high * room + F.element_at(numbers, -1))

    return let(_col(host), lambda h: F.when(h.rlike(rf"^{one}(?:\.{one}){{0,3}}$"), let(F.transform(F.split(h, r"\."), number), whole)))


def ipv6_digits(host: Column | str) -> Column:
    """An IPv6 address as 32 hexadecimal digits, which order like the numbers; else null."""
    quad = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    none = F.array().cast("array<string>")
    pair = lambda n: F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
    groups = lambda c: F.when(c == "", none).otherwise(F.split(c, ":"))
    wide = lambda c: F.array_join(F.transform(c, lambda g: F.lpad(g, 4, "0")), "")

    def without_quad(h: Column) -> Column:
        tail = F.regexp_extract(h, rf":({quad}(?:\.{quad}){{3}})$", 1)
        return let(tail, lambda t: F.when(t == "", h).otherwise(F.concat(F.regexp_replace(h, r"[^:]*$", ""), let(ipv4_number(t), pair))))

    def filled(sides: Column) -> Column:
        cut = F.size(sides) == 2
        return let(
            F.struct(groups(sides[0]).alias("a"), F.when(cut, groups(F.get(sides, F.lit(1)))).otherwise(none).alias("b"), cut.alias("cut"), (F.size(sides) <= 2).alias("ok")),
            lambda x: let(
                F.size(x["a"]) + F.size(x["b"]),
                lambda n: F.when(
                    x["ok"] & F.when(x["cut"], n <= 7).otherwise(n == 8) & F.forall(F.concat(x["a"], x["b"]), lambda g: g.rlike("^[0-9a-f]{1,4}$")),
                    F.concat(wide(x["a"]), F.repeat(F.lit("0000"), F.greatest(8 - n, F.lit(0))), wide(x["b"])),
                ),
            ),
        )

    return let(_col(host), lambda h: F.when(h.contains(":"), let(without_quad(h), lambda t: filled(F.split(t, "::")))))


def is_internal(v4: Column, v6: Column) -> Column:
    """Whether an address (number or digits) is private, loopback, link-local or unspecified; an IPv4 address within IPv6 counts as what it is. Null where there is none."""
    import ipaddress

    def inside(value: Column, networks: tuple[str, ...], edge) -> Column:
        out = F.lit(False)
        for n in map(ipaddress.ip_network, networks):
            out = out | value.between(edge(n.network_address), edge(n.broadcast_address))
        return out

    number, digits = lambda a: F.lit(int(a)).cast("long"), lambda a: F.lit(f"{int(a):032x}")
    four = lambda x: F.coalesce(v4, F.when(x.startswith("0" * 20 + "ffff"), F.conv(F.substring(x, 25, 8), 16, 10).cast("long")))
    of4 = lambda n: inside(n, PRIVATE4, number) & ~inside(n, PUBLIC4, number)
    of6 = lambda x: inside(x, PRIVATE6, digits) & ~inside(x, PUBLIC6, digits)
    return let(v6, lambda x: let(four(x), lambda n: F.when(n.isNotNull(), of4(n)).when(x.isNotNull(), of6(x))))


def host_class(host: Column | str) -> Column:
    """internal or public of a host that is an address in any form, as literal_host() gives it; null of any other."""
    inner = let(_col(host), lambda h: is_internal(ipv4_number(h), ipv6_digits(h)))
    return F.when(inner, "internal").when(~inner, "public")


def internal_reason(url: Column | str, allow_internal: bool = False) -> Column:
    """Why a URL can't be fetched by a collector, else null: ``scheme``, ``host``, ``localhost`` or ``private`` (an address in any form). No name is looked up."""
    scheme = ~F.lower(part(url, 1)).isin("http", "https")

    def of(h: Column) -> Column:
        out = F.when(scheme, "scheme").when(h == "", "host")
        if allow_internal:
            return out
        local = h.isin(*LOCAL_NAMES) | h.endswith(".localhost") | h.endswith(".localhost.localdomain")
        return out.when(local, "localhost").when(is_internal(ipv4_number(h), ipv6_digits(h)), "private")

    return let(literal_host(url), of)


def input_kind(text: Column | str) -> Column:
    """``youtube`` or ``url`` where there is a scheme, else ``text``."""
    t = _col(text)
    return F.when(t.contains("://"), F.when(on_host(t, "youtube.com") | on_host(t, "youtu.be", False), "youtube").otherwise("url")).otherwise("text")


def path_warning(text: Column | str) -> Column:
    """A warning on text that looks like a path on a disk, else null."""
    t = _col(text)
    shaped = ~t.contains("://") & ~t.rlike(r"\s") & t.rlike(r"^(?:[~.]{0,2}[/\\\\]|[A-Za-z]:[/\\\\])")
    return F.when(shaped, "path-shaped text")


# Fixed values.
TITLE_CHARS = 200
URL_IN_TEXT = r"https?://[^\s\"'<>]+"


def pdf_title(url: Column | str) -> Column:
    """A title from a link that points at a ``.pdf``: its last path segment, decoded; null where that gives no clean one."""
    u = _col(url)
    leaf = F.regexp_extract(F.regexp_replace(part(u, 3), "/+$", ""), "([^/]*)$", 1)
    name = F.coalesce(F.try_url_decode(F.replace(leaf, F.lit("+"), F.lit("%2B"))), leaf)
    stem = F.btrim(F.regexp_replace(F.regexp_replace(name, "(?i)\\.pdf$", ""), "[\\x00-\\x1f\\x7f-\\x9f]", ""))
    clean = F.lower(part(u, 1)).isin("http", "https") & name.rlike("(?i)\\.pdf$") & ~stem.isin("", ".", "..") & ~stem.rlike(r"[/\\]")
    return F.when(clean, F.left(stem, F.lit(TITLE_CHARS)))


def shown_title(title: Column | str, url: Column | str, kind: Column | str) -> Column:
    """pdf_title() where the title is only the URL again and the source is a PDF, else the title."""
    return F.when((_col(title) == _col(url)) & (_col(kind) == "pdf"), F.coalesce(pdf_title(url), _col(title))).otherwise(_col(title))


def bare_host(url: Column | str) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(url, 2), "^.*@", ""), ":[0-9]*$", ""))


def under_host(url: Column | str, host: str) -> Column:
    h = bare_host(url)
    return (h == host) | h.endswith("." + host)


def names_host(text: Column | str, host: str) -> Column:
    """Whether any URL in a text is on a host or below it."""
    return F.exists(F.regexp_extract_all(_col(text), F.lit(URL_IN_TEXT), 0), lambda u: under_host(u, host))


def first_hop(hops: Column | str, host: str, path: str) -> Column:
    """The first URL of a redirect chain that is on a host and has a path, in any case and without slashes around it; else null."""
    fits = lambda u: under_host(u, host) & (F.lower(F.regexp_replace(part(u, 3), "^/+|/+$", "")) == path)
    return F.try_element_at(F.filter(_col(hops), fits), F.lit(1))


def share_url(base: str, key: Column | str) -> Column:
    """A path segment holds the whole key: everything but letters, digits and ``-._~`` is percent-encoded."""
    coded = F.url_encode(_col(key))
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        coded = F.replace(coded, F.lit(a), F.lit(b))
    return F.concat(F.lit(base), coded)
