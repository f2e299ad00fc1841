"""Anonymising column functions, in the order in which they must run.

Mail addresses go before URLs: the URL rule takes a bare host too, and would eat the
host half of an address. compat_order=True keeps the opposite order. Letters and digits of
any script count in words ((?U), which the SQL twins spell with the same classes)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of what is replaced, and hosts that are kept.
EMAIL_RE = r"[\p{L}\p{M}\p{N}_.+-]+@[\p{L}\p{M}\p{N}_.-]+\.[A-Za-z]{2,}"
PHONE_RE = r"(?:\+?[0-9]{1,3}[-.\s]?)?(?:\(?[0-9]{2,4}\)?[-.\s]?)?[0-9]{3,4}[-.\s]?[0-9]{4}"
MONEY_RE = r"(?:[$₩¥€£]|\bKRW\s|\bUSD\s|\bEUR\s)\s*[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?"
DATE_RE = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b"
URL_RE = r"(?:https?://)?[\p{L}\p{M}\p{N}_.-]+\.[A-Za-z]{2,}(?:/[^\s?#]*)?(?:\?[^\s#]*)?"
# What takes the place of each.
EMAIL_TO, PHONE_TO, MONEY_TO, DATE_TO, URL_TO = "user@example.com", "+00-0000-0000", "[AMOUNT]", "[DATE]", "https://example.com/X"
KEY_RES = (
    r"sk-[A-Za-z0-9_-]{20,}",
    r"ghp_[A-Za-z0-9]{36}",
    r"github_pat_[A-Za-z0-9_]{70,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"xox[bpoa]-[A-Za-z0-9-]{20,}",
    r"sk-ant-[A-Za-z0-9_-]{40,}",
)
PUBLIC_HOSTS = (
    "arxiv.org", "github.com", "wikipedia.org", "youtube.com", "youtu.be", "google.com", "scholar.google.com", "openai.com",
    "anthropic.com", "news.ycombinator.com", "reddit.com", "stackoverflow.com", "semanticscholar.org", "papers.nips.cc", "openreview.net",
)
#: A URL whose host is exactly one of those: (scheme, host, path).
PUBLIC_RE = r"(?i)(?<![\p{L}\p{M}\p{N}_.-])(https?://)?(" + "|".join(h.replace(".", "[.]") for h in PUBLIC_HOSTS) + r")(?![\p{L}\p{M}\p{N}_.-])(/[^\s?#]*)?(?:[?][^\s#]*)?"


def email(c: Column) -> Column:
    return F.regexp_replace(c, EMAIL_RE, EMAIL_TO)


def phone(c: Column) -> Column:
    return F.regexp_replace(c, PHONE_RE, PHONE_TO)


def money(c: Column) -> Column:
    return F.regexp_replace(c, MONEY_RE, MONEY_TO)


def iso_date(c: Column) -> Column:
    return F.regexp_replace(c, DATE_RE, DATE_TO)


#: Private-use marks around a kept URL while the second pass runs.
OPEN, CLOSE = "\ue000", "\ue001"


def url(c: Column) -> Column:
    """Exactly the public hosts keep host and path and lose the query; all others, their
    subdomains too, are replaced. A kept host is written in lower case, with https:// if it
    had no scheme."""
    kept = F.regexp_replace(c, PUBLIC_RE, f"{OPEN}$1 $2 $3{CLOSE}")
    parts = F.split(kept, f"(?={OPEN})|(?<={CLOSE})")
    field = lambda p, i: F.split(F.translate(p, OPEN + CLOSE, ""), " ")[i]
    whole = lambda p: F.concat(F.coalesce(F.nullif(field(p, 0), F.lit("")), F.lit("https://")), F.lower(field(p, 1)), field(p, 2))
    done = F.transform(parts, lambda p: F.when(p.startswith(OPEN), whole(p)).otherwise(F.regexp_replace(p, URL_RE, URL_TO)))
    return F.when(c.isNotNull(), F.array_join(done, ""))


def slug_names(slugs: list[str]) -> dict[str, str]:
    """Placeholder of every known slug, by its place in the list: sixteen letters, then numbers."""
    known = list(dict.fromkeys(s for s in slugs if s))
    return {s: f"project-{chr(97 + i)}" if i < 16 else f"project-x-{i - 15}" for i, s in enumerate(known)}


def known_slugs(c: Column, slugs: list[str], limit: int = 10_000) -> Column:
    """Every known slug, whole and in any case, by its own placeholder, in one pass over the
    text; of slugs that overlap the longer one counts. A slug keeps its placeholder in all
    texts, found there or not. The list is refused beyond `limit`: it goes to every task."""
    names = slug_names(slugs)
    if len(names) > limit:
        raise ValueError("the list of known slugs is too long for one pattern")
    if not names:
        return c
    quoted = lambda s: "".join(ch if ch.isalnum() or ch in "-_ " else f"[{ch}]" if ch not in "^\\]" else "\\" + ch for ch in s)
    any_of = "|".join(quoted(s) for s in sorted(names, key=lambda s: (-len(s), s)))
    found = rf"(?iU)\b(?:{any_of})\b"
    by_name = F.create_map(*(F.lit(x) for s, n in names.items() for x in (s.lower(), n)))
    # cut around the finds, then look each of them up
    parts = F.split(F.regexp_replace(c, found, f"{OPEN}$0{CLOSE}"), f"(?={OPEN})|(?<={CLOSE})")
    one = lambda p: F.when(p.startswith(OPEN), F.element_at(by_name, F.lower(F.translate(p, OPEN + CLOSE, "")))).otherwise(p)
    return F.when(c.isNotNull(), F.array_join(F.transform(parts, one), ""))


def chain(c: Column, slugs: list[str] | None = None, compat_order: bool = False, names: Callable[[Column], Column] | None = None) -> Column:
    """All rules in order. `names` stands between the patterns and the guard: a column
    function, such as a model in a Pandas function, that replaces personal names."""
    c = known_slugs(c, slugs or [])
    c = email(url(c)) if compat_order else url_keep_mail(email(c))
    c = iso_date(money(phone(c)))
    return names(c) if names else c


def url_keep_mail(c: Column) -> Column:
    """URL rule beside the mail placeholder, which it must not touch."""
    parts = F.split(c, "(?=user@example[.]com)|(?<=user@example[.]com)")
    return F.when(c.isNotNull(), F.array_join(F.transform(parts, lambda p: F.when(p == EMAIL_TO, p).otherwise(url(p))), ""))


def residual_secret(c: Column) -> Column:
    """A key-shaped string is left in the text."""
    return c.rlike("|".join(f"\\b{k}\\b" for k in KEY_RES))
