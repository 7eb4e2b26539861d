import hashlib
import random
import re

import pytest

from flowseq.llm import pii
from tests.llm.data import ODD, frame

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end()) for k, (name, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(name, m[0])]
    return sorted(found)


def test_strict_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    parts = ["a@b.co", "x.y@", "@", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 222-3333", "+", "12", " ", "-", ".", "é", "a", "(9)", "me@host.org.", "00.00.0.255"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))
        assert pii.strict_spans(text)[0] == brute(text), text


def test_long_texts_take_linear_time():
    for text in ("9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "a@" * 50_000, "at dot " * 30_000):
        pii.candidates(text)


def test_digest(spark):
    texts = [*ODD, "mail a.b@c.org and 4111 1111 1111 1111, 10.0.0.1 é +1 (415) 555-2671"]
    rows = {r["doc_id"]: r for r in pii.digest(pii.detect(frame(spark, texts))).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        base = ",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in brute(text))
        assert rows[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(rows[i]["spans"].split(","))
        assert [rows[i][f"n_{n}"] for n, _ in PATTERNS] == [sum(k == j for _, k, _ in brute(text)) for j in range(4)]


def test_method_adds_obfuscated_spans_and_leaves_prose(spark):
    texts = [f"please write to person{i}@mail.example.com or call +1 (415) 555-{2000 + i} today" for i in range(60)]
    texts += ["contact jane.doe [at] example [dot] org soon", "we met at noon and the dot was red", "plain words only", "call (415) 555-2671 now"]
    rows = {r["doc_id"]: r for r in pii.digest(pii.detect(frame(spark, texts))).collect()}
    assert rows[60]["spans"].startswith("email:") and rows[63]["spans"].startswith("phone:")
    assert rows[61]["spans"] == rows[62]["spans"] == ""


def test_expectation_maximisation_finds_the_bad_labeler():
    import numpy as np

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    good = lambda p: np.where(rng.random(4000) < p, truth, ~truth)
    votes = np.stack([good(0.95), good(0.9), good(0.85), good(0.5)], 1).astype(int) * 2
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    post, theta = pii.expectation_maximisation(rows, counts.astype(float))
    by = dict(zip(map(tuple, rows), post, strict=True))
    assert np.mean((np.array([by[tuple(v)] for v in votes]) > 0.5) == truth) > 0.93
    assert theta[1][0][2] > 0.85 and abs(theta[1][3][2] - theta[0][3][2]) < 0.1


def test_redaction_and_empty_table(spark):
    out = pii.redact(frame(spark, ["to a@b.org or 10.0.0.1.", None, "clean"])).collect()
    assert [r["text"] for r in out] == ["to <EMAIL> or <IP>.", None, "clean"]
    assert pii.digest(pii.detect(frame(spark, ["x"]).limit(0))).count() == 0


@pytest.mark.parametrize("ids", [[5, 5, None]])
def test_repeated_and_missing_ids(spark, ids):
    assert pii.detect(frame(spark, ["a@b.org"] * 3, ids)).count() == 3


def test_added_spans_never_overlap():
    """Compared with a scan of everything taken, the likeliest first."""
    rng = random.Random(9)
    parts = ["jo [at] ex [dot] org", "(415) 555-2671", "1[.]2[.]3[.]4", "a@b.co", "4111 1111 1111 1112", "999.1.1.1", "+1 (555) 222-3333", " ", "-", "call "]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        good, found = pii.candidates(text)
        known = {c: rng.random() for *_, c in found}
        taken, added = [(s, e) for s, _, e in good], []
        for p, s, k, e in sorted((-known[c], s, k, e) for s, k, e, c in found if (s, k, e) not in set(good)):
            if -p >= pii.ACCEPT and not any(a < e and s < b for a, b in taken):
                added.append((s, k, e))
                taken.append((s, e))
        assert pii.find_spans(text, known) == (good, sorted(good + added))
