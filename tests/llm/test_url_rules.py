"""Lists of rules from files, more rules than an index holds, and the patterns that the query has."""

from __future__ import annotations

import random
import re

import pytest

from motifspark.llm.url_filters import PATTERNS, Rule, judge_urls, literal_tokens, read_rules


def made(seed=3):
    rng = random.Random(seed)
    hosts = [f"{rng.choice('abcd')}{rng.randint(0, 9)}.{rng.choice(['com', 'org'])}" for _ in range(60)]
    rules = [Rule(rng.choice(["allow", "block"]), x) for x in sorted({f"{rng.choice(hosts)}/{rng.choice(['', 'en/', 'de/', 'en/1'])}" for _ in range(150)} | {"com/"})]
    urls = [f"http://{rng.choice(['', 'www.', 'casino.', 'x.'])}{rng.choice([*hosts, 'other.net'])}/{rng.choice(['', 'en/', 'de/2', 'en/12', 'login', 'a/b.JPG', 'a?utm_x=1', 'a?gclid=2', 'wp-admin/x', 'loginx', 'a.jpgx'])}" for _ in range(500)]
    return rules, [*urls, None, "", "no scheme/login", "ftp://a1.com", "http://a1.com/login", "http://a1.com/login"]


@pytest.mark.parametrize("most", [1, 7, 100])
def test_rules_in_blocks_are_as_all_at_once(spark, most):
    rules, urls = made()
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    patterns = [r"/login\b", r"[?&]utm_[a-z]+=", r"://[^/?#]*\bcasino\b"]
    some = rules if most > 1 else rules[:6]
    rows = lambda n: sorted(map(tuple, judge_urls(frame, some, patterns, n).collect()))
    want = rows(1_000_000)
    assert rows(most) == want
    assert {r[4] for r in want} == {"allow", "block"} and len({r[3] for r in want}) > 3


def test_rules_from_a_file(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("# comment\nallow org/\n\nblock  example.org/es/\npattern /ads\\b\n")
    rules, patterns = read_rules(spark, str(tmp_path / "rules.txt"))
    assert rules == [Rule("allow", "org/"), Rule("block", "example.org/es/")] and patterns == [r"/ads\b"]
    (tmp_path / "bad.txt").write_text("deny x/\n")
    with pytest.raises(ValueError, match="deny"):
        read_rules(spark, str(tmp_path / "bad.txt"))


def test_every_pattern_has_a_token_that_its_urls_hold(spark):
    """But the first, whose parameter is open; and the verdicts are those of a scan with all patterns."""
    assert len(PATTERNS) > 150 and all(literal_tokens(x) for x in PATTERNS[1:])
    assert literal_tokens(r"://[^/?#]*\bcasino\b") == {"casino"} and literal_tokens(r"/wp-admin\b") == {"wp", "admin"}
    _, urls = made(5)
    words = ["casino", "poker", "login", "logins", "x.zip", "zip", "rss", "rs"]
    urls += [f"https://{a}.example.net/{b}" for a in words for b in words]
    got = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), []).collect()}
    assert got == {k: "block" if any(re.search(p, (u or "").lower()) for p in PATTERNS) else "allow" for k, u in enumerate(urls)}
