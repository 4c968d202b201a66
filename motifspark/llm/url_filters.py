"""URL filters: pattern rules found through their rarest literal token.

Rules and patterns are regular expressions, but no URL meets all of them: each
is filed under one literal token that every matching URL must hold, the rarest
of its tokens in the corpus' own token counts.  The tokens of a pattern are
taken out of the pattern itself.  A URL is cut into tokens, these fetch the
candidates, and only candidates run.  What has no such token runs on every URL.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import stored

_TOKEN = re.compile(r"[a-z0-9]+")
_SPLIT_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)


@dataclass(frozen=True)
class Rule:
    """host/path prefix rule: `allow` or `block` for a host, its subdomains, and paths that begin alike."""

    action: str
    name: str

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.name.partition("/")[2]

    def tokens(self) -> set[str]:
        """Literal tokens that a fitting URL holds whole: the host's, and the path's up to its last separator."""
        path = self.path.lower()
        whole = path[: max((m.end() for m in re.finditer(r"[^a-z0-9]", path)), default=0)]
        return set(_TOKEN.findall(self.host.lower())) | set(_TOKEN.findall(whole))


RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))
#: Words of hosts, path parts and parameters that tell URLs of no use as text: gambling, adult, pharmacy, credit and piracy sites; accounts,
#: shops, machine-made listings and files; tracking and session parameters.
HOST_WORDS = (
    "casino casinos poker slots jackpot roulette blackjack baccarat lottery lotto bookmaker sportsbook betting porn porno xxx sex sexcam adult escort escorts "
    "hentai nude nudes milf fetish webcam webcams viagra cialis levitra xanax tramadol pharmacy pills replica replicas payday loan loans forex binary torrent "
    "torrents warez crack cracks keygen serials proxy vpn adserver adservice ads doubleclick tracker tracking click clicks popads"
).split()
PATH_WORDS = (
    "login logout signin signup register password cart basket checkout wishlist account orders invoice ads advert adverts banner banners sponsored affiliate "
    "affiliates outgoing redirect unsubscribe subscribe captcha sitemap rss atom feed feeds trackback xmlrpc calendar print printable share tags taglist "
    "cgi-bin wp-admin wp-login wp-json phpmyadmin"
).split()
FILE_ENDINGS = "jpg jpeg png gif webp svg ico mp3 mp4 avi mkv mov wav zip rar gz tgz iso exe dmg apk msi css js woff woff2 ttf".split()
PARAMETERS = "ref gclid fbclid msclkid dclid yclid sessionid jsessionid phpsessid sid aspsessionid replytocom affid aff_id clickid click_id add-to-cart orderby".split()
#: Patterns of blocked URLs, for those that no rule fits.
PATTERNS = (
    r"[?&]utm_[a-z]+=", r"://blog\.", *(rf"://[^/?#]*\b{x}\b" for x in HOST_WORDS), *(rf"/{x}\b" for x in PATH_WORDS), *(rf"://[^/]*/[^?#]*\.{x}\b" for x in FILE_ENDINGS), *(rf"[?&]{x}=" for x in PARAMETERS),
)
MOST_RULES = 1_000_000  # of an index that every worker holds; more are asked in turn


def literal_tokens(pattern: str) -> set[str]:
    """Tokens that every lower-cased text which the pattern finds holds whole.

    These are runs of literal letters and digits outside of choices and
    repeats, with something beside them on both sides that can't be a letter
    or digit: such a literal, a class of such, or an edge of a word or text.
    """
    items = _pieces(re._parser.parse(pattern))
    found, at = set(), 0
    while at < len(items):
        end = at
        while end < len(items) and items[end] is not None and _TOKEN.fullmatch(items[end]):
            end += 1
        if end > at and at > 0 and items[at - 1] == "" and end < len(items) and items[end] == "":
            found.add("".join(items[at:end]))
        at = max(end, at + 1)
    return found


def _pieces(parsed) -> list[str | None]:
    """A pattern's parts in order: a letter or digit, "" for what can't be one, None for anything else."""
    out: list[str | None] = []
    for kind, value in parsed:
        name = str(kind)
        if name == "LITERAL":
            out.append(chr(value) if _TOKEN.fullmatch(chr(value)) else None if chr(value).isalnum() else "")
        elif name == "AT":
            out.append("" if str(value) in ("AT_BOUNDARY", "AT_BEGINNING_STRING", "AT_END_STRING") else None)
        elif name == "IN":
            plain = all(str(k) == "LITERAL" and not chr(v).isalnum() for k, v in value)
            out.append("" if plain else None)
        elif name == "SUBPATTERN" and not value[1] and not value[2]:
            out += _pieces(value[3])
        else:
            out.append(None)
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for a null or a URL without `://`."""
    found = _SPLIT_URL.search(url or "")
    if not found:
        return "", ""
    return re.sub("[A-Z]+", lambda m: m[0].lower(), found[1]), found[2]


def url_tokens(url: str | None) -> set[str]:
    return set(_TOKEN.findall((url or "").lower()))


class RuleIndex:
    """Rules and patterns by their rarest token; counts: how often the corpus holds a token."""

    def __init__(self, rules: Sequence[Rule], patterns: Sequence[str], counts: dict[str, int]):
        self.rules, self.patterns, self.always, self.everywhere = defaultdict(list), defaultdict(list), [], []
        rarest = lambda tokens: min(tokens, key=lambda t: (counts.get(t, 0), t))
        for rule in rules:
            tokens = rule.tokens()
            (self.rules[rarest(tokens)] if tokens else self.always).append((rule, re.compile(rf"(?:.*\.)?{re.escape(rule.host)}\Z", re.S)))
        for pattern in patterns:
            tokens = literal_tokens(pattern)
            (self.patterns[rarest(tokens)] if tokens else self.everywhere).append(re.compile(pattern))

    def ask(self, url: str | None) -> tuple[str, str, str | None, str | None, bool]:
        """(host, path, rule or None, its action, whether a pattern is found); the longest fitting rule wins, a block before an allow of its length."""
        host, path = split_url(url)
        tokens = url_tokens(url)
        found = [*self.always, *(e for t in tokens for e in self.rules.get(t, ()))]
        fits = [rule for rule, pattern in found if path.startswith(rule.path) and pattern.match(host)]
        if fits:
            best = max(fits, key=rank)
            return host, path, best.name, best.action, False
        lower = (url or "").lower()
        blocked = any(p.search(lower) for p in self.everywhere) or any(p.search(lower) for t in tokens for p in self.patterns.get(t, ()))
        return host, path, None, None, blocked


def rank(rule: Rule) -> tuple:
    """What the winning one of several fitting rules has the most of."""
    return len(rule.name), rule.action, rule.name


def read_rules(spark, path: str) -> tuple[list[Rule], list[str]]:
    """(rules, patterns) of a text file with a line for each: `allow host/path`, `block host/path` or `pattern expression`; empty lines and those from # on are skipped.

    Raises ValueError for other lines.  The lines are held by the driver.
    """
    rules, patterns = [], []
    for row in spark.read.text(path).toLocalIterator():
        line = row[0].strip()
        kind, _, value = line.partition(" ")
        if kind in ("allow", "block") and "/" in value:
            rules.append(Rule(kind, value.strip()))
        elif kind == "pattern" and value.strip():
            patterns.append(re.compile(value.strip()).pattern)
        elif line and not line.startswith("#"):
            raise ValueError(f"no rule: {line!r}")
    return rules, patterns


def judge_urls(pages: DataFrame, rules=RULES, patterns=PATTERNS, most_rules: int = MOST_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    A rule fits its host and all subdomains if the path begins with the
    rule's; the longest wins, and of two names of one length a block.  Where
    none fits, a URL in which, lower-cased, one of the patterns is found is
    blocked and any other allowed.  Null URLs and those without `://`
    have an empty host and path and fit no rule.  Repeated rows and ids are
    judged each by itself; other columns are ignored.

    The index grows with the rules, not with the pages.  More than most_rules
    rules and patterns are asked block by block: the pages travel once more
    for each, with the best rule so far.
    """
    rules, patterns = tuple(rules), tuple(patterns)
    spark = pages.sparkSession
    both = [*rules, *patterns]
    blocks = [both[k : k + most_rules] for k in range(0, len(both), most_rules)] or [[]]
    found = pages.select(F.col("page_id").cast("long").alias("page_id"), "url")
    for k, block in enumerate(blocks):
        found = _asked(found if k == 0 else stored(found, "judged"), [x for x in block if isinstance(x, Rule)], [x for x in block if not isinstance(x, Rule)], spark)
    verdict = F.coalesce("action", F.when(F.col("found"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _asked(pages: DataFrame, rules: list[Rule], patterns: list[str], spark) -> DataFrame:
    """(page_id, url, host, path, rule, action, found) by these rules and patterns, and by those that pages have been asked before."""
    wanted = sorted({t for r in rules for t in r.tokens()} | {t for x in patterns for t in literal_tokens(x)})
    known = spark.createDataFrame([(t,) for t in wanted], "token string")
    words = pages.select(F.explode(F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))).alias("token"))
    counts = {r[0]: r[1] for r in words.join(F.broadcast(known), "token").groupBy("token").count().toLocalIterator()}
    index = spark.sparkContext.broadcast(RuleIndex(rules, patterns, counts))
    before = "rule" in pages.columns

    def work(stream):
        for batch in stream:
            rows = [index.value.ask(x) for x in batch.column("url").to_pylist()]
            if before:
                for k, (name, action, had) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("rule", "action", "found")), strict=True)):
                    host, path, own, own_action, now = rows[k]
                    if name is not None and (own is None or rank(Rule(action, name)) >= rank(Rule(own_action, own))):
                        own, own_action = name, action
                    rows[k] = host, path, own, own_action, had or now
            kinds = {"host": pa.string(), "path": pa.string(), "rule": pa.string(), "action": pa.string(), "found": pa.bool_()}
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url")} | {name: pa.array([x[k] for x in rows], kind) for k, (name, kind) in enumerate(kinds.items())})

    return pages.mapInArrow(work, "page_id long, url string, host string, path string, rule string, action string, found boolean")
