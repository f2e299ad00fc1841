"""Column functions over URLs and attachments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of a URL in text, file types of attachments and the host names of each source.
URL_RE = r"(?i)https?://[^\s<>()\[\]{}\"']+[^\s<>()\[\]{}\"'.,;:!?]"
PDF_MIMES = ("application/pdf", "application/x-pdf")
HWP_MIMES = ("application/vnd.hancom.hwp", "application/x-hwp", "application/haansofthwp", "application/vnd.hancom.hwpx")
OFFICE_MIMES = (
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "application/msword", "application/vnd.ms-excel", "application/vnd.ms-powerpoint",
)
HWP_EXTS = (".hwp", ".hwpx")
OFFICE_EXTS = (".docx", ".xlsx", ".pptx", ".doc", ".xls", ".ppt")
TEXT_EXTS = (".txt", ".md", ".markdown", ".csv", ".tsv", ".json", ".yaml", ".yml", ".log", ".rst", ".ini", ".toml", ".xml")
METADATA_HOSTS = ("metadata.google.internal", "metadata", "instance-data")
# IPv4 networks that are private, local, reserved or multicast, and the shared one.
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
BLOCKED_V4 = ("100.64.0.0/10",)
VIDEO = ("youtube.com/watch", "youtu.be/", "youtube.com/shorts/")
ARXIV = ("arxiv.org/abs/", "arxiv.org/pdf/")
SOCIAL = ("instagram.com", "instagr.am", "tiktok.com", "vm.tiktok.com")


def _any(c: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(c, F.lit(n))
    return out


def _ends(c: Column, tails) -> Column:
    out = F.lit(False)
    for t in tails:
        out = out | c.endswith(t)
    return out


def extract_urls(c: Column, most: int = 3) -> Column:
    """URLs of a text, each once, in order, at most `most`."""
    return F.slice(F.array_distinct(F.regexp_extract_all(c, F.lit(URL_RE), 0)), 1, most)


def url_slug(url: Column) -> Column:
    tail = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    tail = F.trim(F.regexp_replace(F.regexp_replace(tail, r"[?#].*$", ""), "[^a-zA-Z0-9._-]+", "-"), F.lit("-"))
    return F.when(F.length(tail).between(3, 50), F.lower(tail)).otherwise(F.substring(F.sha2(url, 256), 1, 8))


def raw_path(day: Column, source: Column, slug: Column) -> Column:
    return F.concat(F.lit("raw/"), day, F.lit("-"), source, F.lit("-"), slug, F.lit(".md"))


def clean_url(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def source_type(url: Column) -> Column:
    """Coarse kind of a reference; the first rule that fits decides."""
    u = F.lower(url)
    return (
        F.when(F.coalesce(u, F.lit("")) == "", "text")
        .when(F.contains(u, F.lit("arxiv.org")), "paper")
        .when(F.contains(u, F.lit("github.com")), "code")
        .when(_any(u, ("youtube.com", "youtu.be")), "video")
        .when(_any(u, ("stackoverflow.com", "stackexchange.com")), "discussion")
        .when(u.endswith(".pdf") | F.contains(u, F.lit("/pdf/")), "pdf")
        .otherwise("web")
    )


def authority(url: Column) -> Column:
    """Host with user and port, as written between // and the path; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def dispatch(url: Column) -> Column:
    """Extractor of a URL: video, arXiv, PDF, social, office, web, in this order."""
    u = F.lower(url)
    return (
        F.when(_any(url, VIDEO), "youtube").when(_any(url, ARXIV), "arxiv").when(u.endswith(".pdf"), "pdf").when(_any(u, SOCIAL), "social").when(_ends(u, OFFICE_EXTS), "office").otherwise("web")
    )


def video_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:youtube\.com/watch\?v=|youtu\.be/|youtube\.com/shorts/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def arxiv_id(url: Column) -> Column:
    """Identifier in the old or new form, without its version."""
    return F.nullif(F.regexp_extract(url, r"(?i)arxiv\.org/(?:abs|pdf)/([a-z-]+/\d{7}|\d{4}\.\d{4,5})(v\d+)?", 1), F.lit(""))


def attachment_class(mime: Column, name: Column) -> Column:
    m, n = F.lower(F.coalesce(mime, F.lit(""))), F.lower(F.coalesce(name, F.lit("")))
    return (
        F.when(m.startswith("image/"), "image")
        .when(m.isin(*PDF_MIMES) | n.endswith(".pdf"), "pdf")
        .when(m.isin(*HWP_MIMES) | _ends(n, HWP_EXTS), "hwp")
        .when(m.isin(*OFFICE_MIMES) | _ends(n, OFFICE_EXTS), "office")
        .when(m.startswith("text/") | _ends(n, TEXT_EXTS), "text")
        .otherwise("unknown")
    )


def safe_url(url: Column) -> Column:
    """'ok' or the reason why a URL must not be fetched, from its text alone: scheme,
    host, cloud metadata names, literal private, loopback, link-local, shared, multicast
    and reserved IPv4 addresses. Names are not resolved."""
    scheme = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    place = F.regexp_replace(authority(url), r"^.*@", "")
    boxed = F.regexp_extract(place, r"^\[([^\]]*)\](?::\d*)?$", 1)  # the address of [::1]:80
    host = F.regexp_replace(F.regexp_replace(place, r":\d*$", ""), r"\.+$", "")
    digits = host.rlike(r"^(?:0x[0-9a-f]*|\d+)(?:\.(?:0x[0-9a-f]*|\d+))*$")
    quad = host.rlike(r"^(?:0|[1-9]\d{0,2})(?:\.(?:0|[1-9]\d{0,2})){3}$")
    return (
        F.when(~scheme.isin("http", "https"), "scheme_not_allowed")
        .when(boxed != "", F.when(_private_v6(boxed), "private_ip").when(boxed.rlike(r"^[0-9a-f:.]+$"), "ok").otherwise("invalid_ip"))
        .when((host == "") | host.startswith("["), "no_hostname")
        .when(host.isin(*METADATA_HOSTS), "metadata_host")
        .when(host.rlike(r"(^|\.)localhost$"), "private_ip")
        .when(digits & ~quad, "encoded_ip")
        .when(quad & _in_nets(host, BLOCKED_V4), "blocked_net")
        .when(quad & (_in_nets(host, PRIVATE_V4) | F.exists(F.split(host, r"\."), lambda p: p.cast("int") > 255)), "private_ip")
        .otherwise("ok")
    )


def _in_nets(quad: Column, nets: tuple[str, ...]) -> Column:
    """A dotted quad lies in one of the networks a.b.c.d/bits."""
    number = F.aggregate(F.split(quad, r"\."), F.lit(0).cast("long"), lambda acc, p: acc * 256 + F.coalesce(p.try_cast("long"), F.lit(0)))
    out = F.lit(False)
    for net in nets:
        base, bits = net.split("/")
        low = sum(int(x) << (24 - 8 * i) for i, x in enumerate(base.split(".")))
        out = out | number.between(low, low + (1 << (32 - int(bits))) - 1)
    return out


def _private_v6(address: Column) -> Column:
    """Loopback, unspecified, mapped or translated IPv4, local, link-local, multicast and
    documentation addresses, by the groups before the first gap."""
    first = F.lpad(F.regexp_extract(address, r"^([0-9a-f]{1,4}):", 1), 4, "0")
    outside = address.rlike(r"^[23][0-9a-f]{3}:")  # of the global range alone
    odd = address.rlike(r"^2001:(?:0{0,3}db8|0{1,4}|0{0,2}[0-9a-f]{1,2}|:)(?::|$)") | first.isin("2002")
    return ~outside | odd | F.contains(address, F.lit("."))
