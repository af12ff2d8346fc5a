"""Native operators and scans against plain Python."""

import collections
import hashlib
import math
import random
import re

from listenflow.llm import exact_dedup, pii, quality_rules, secret_scan
from tests.llm.cases import documents, empty, rows_by_id, texts, words

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
       "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
       "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TRICKY = ["a@b.cd_x@e.fg h+1@x", "😀 a@b.co 1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255", "++1 22 3333333 +12 +1-",
          " ".join(f"1.2.3.{i % 300}" for i in range(400)), "4111-1111-1111-1111- 4111 1111 1111 1112"]


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def holds(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in v.split(".")),
            "card": kind == "card" and 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def pii_spans(t):
    return [(k, m.start(), m.end()) for k, p in PII.items() for m in re.finditer(p, t or "") if holds(k, m.group())]


def test_pii_spans(spark):
    """Base spans equal the contract's; a context the seeds teach finds a number they miss."""
    seeds = [f"call the tel no: +1 (217) 555-{i:04d} now" for i in range(20)]
    more = TRICKY + seeds + ["call the tel no: (217) 555-9999 now", "part number 217 555 9999 is in stock"]
    got = rows_by_id(pii.digest(pii.find_personal_data(documents(spark, more))))
    everything = [*texts(), *more]
    for i, t in enumerate(everything):
        spans = pii_spans(t)
        r = got[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in PII], t
        joined = ["%s:%d:%d" % s for s in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest(), t
        assert set(joined) <= set(r.spans.split(","))
    n = len(everything)
    assert got[n - 2].spans == "phone:17:31" and got[n - 2].n_phone == 0
    assert got[n - 1].spans == ""
    assert pii.digest(pii.find_personal_data(empty(spark))).count() == 0


def base_rules(t):
    w = words(t)
    count = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if count[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered)


def test_quality_base_counts(spark):
    more = ["$$$ a|b <c> #1 100% &", "p q r s t p q r s t p q r s", "\r\nx\r\n\nx\r\n"]
    got = rows_by_id(quality_rules.quality_rules(documents(spark, more)))
    for i, t in enumerate([*texts(), *more]):
        r, want = got[i], base_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_quality_distance_drops_junk(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality_rules.quality_rules(d).join(lab, "doc_id").where("not base_failed").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0 and r.n_words >= 200]
    assert sum(not r.kept for r in good) == 0
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_exact_dedup(spark):
    got = rows_by_id(exact_dedup.exact_dedup(documents(spark)))
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts()):
        groups[t or ""].append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    d = documents(spark)
    kept = exact_dedup.drop_exact_duplicates(d.union(d))     # every row twice
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(ids) for ids in groups.values())
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def secret_base(t):
    out = [("assign", m) for m in re.finditer(
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I)
        if len(m.group(2)) >= 6]
    out += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 20]
    out += [("hex", m) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(((m.start(), order[k], k, m.end()) for k, m in out))


def test_secret_spans(spark):
    more = ["API_KEY='abcdefgh1' token=short passwd : aa secret = ghijkl", "Login is Tr0ub4dor&3x!", "pin: 123456"]
    got = rows_by_id(secret_scan.scan_secrets(documents(spark, more)))
    for i, t in enumerate([*texts(), *more]):
        want = secret_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(
            ",".join(f"{k}:{s}:{e}" for s, _, k, e in want).encode()).hexdigest(), t
    n = len(texts())
    assert "guess:" in got[n - 1].spans and "guess:9:22" in got[n + 1].spans and got[n + 2].spans == ""
    masked = rows_by_id(secret_scan.mask_secrets(documents(spark, more)))
    assert masked[0].text is None and masked[n + 1].text == "Login is [SECRET]" and masked[n].source == "s"
    assert secret_scan.scan_secrets(empty(spark)).count() == 0


def test_guess_cost():
    cost = secret_scan.guess_cost
    for weak in ("password1", "qwertyuiop", "aaaaaaaaaaaa", "20240101", "changeme123", "abcdefgh", "abcabcabcabc"):
        assert cost(weak) < 6, weak
    assert cost("kX9#mQ2vL7pw") > 15
    assert cost("kX9#mQ2vL7pw" * 20) > 15       # longer than one block


def test_quality_keeps_a_language_of_its_own(spark):
    """One clean document in a script of its own among 1,000 others, and many languages."""
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(40)]
    latin = [" ".join(rnd.choice(vocabulary) for _ in range(200)) for _ in range(1000)]
    greek = ["".join(rnd.choice("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(rnd.randint(3, 9))) for _ in range(400)]
    rows = [(i, t, "en") for i, t in enumerate(latin)] + [(1000, " ".join(greek), "el")]
    got = rows_by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert got[1000].char_distance > quality_rules.MAX_CHAR_DISTANCE and got[1000].kept
    assert all(got[i].kept for i in range(1000))


def test_quality_languages_beyond_the_literals(spark, monkeypatch):
    """Small languages are judged by their own reference, joined on the language."""
    monkeypatch.setattr(quality_rules, "LANGUAGES", 1)
    rnd = random.Random(5)

    def texts_of(letters, n, size):
        vocabulary = ["".join(rnd.choice(letters) for _ in range(rnd.randint(2, 7))) for _ in range(40)]
        return [" ".join(rnd.choice(vocabulary) for _ in range(size)) for _ in range(n)]
    rows = [(t, "en") for t in texts_of("abcdefghij", 300, 200)] + [(t, "el") for t in texts_of("αβγδεζηθικ", 60, 200)]
    rows += [("9" * 40 + " " + " ".join("#%$&" * 5 for _ in range(90 + i)), "el") for i in range(2)]
    d = spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string")
    got = rows_by_id(quality_rules.quality_rules(d))
    assert all(got[i].kept for i in range(360))
    assert got[310].char_distance < 0.2
    assert all(got[i].char_distance > quality_rules.MAX_CHAR_DISTANCE for i in (360, 361))


def test_pii_second_generation(spark):
    """Addresses behind 'write to' are reached only by way of candidates that the
    seeded pattern 'contact mail:' has found."""
    seeds = [f"our contact mail: s{i}@x.org now" for i in range(20)]
    both = [f"our contact mail: joe{i} (at) x dot org now" for i in range(10)]
    again = [f"please write to joe{i} (at) x dot org now" for i in range(10)]
    only = "please write to ann (at) y dot org now"
    more = seeds + both + again + [only, "the cat sat kim (at) z dot org now"]
    got = rows_by_id(pii.digest(pii.find_personal_data(documents(spark, more))))
    first = len(texts())
    n = first + len(more)
    assert all(got[i].n_added == 1 for i in range(first + 20, n - 1))
    start = only.index("ann")
    assert got[n - 2].spans == f"email:{start}:{start + len('ann (at) y dot org')}"
    assert got[n - 1].spans == ""


def test_secrets_of_one_kind_of_character(spark):
    """The guess cost alone decides; frequent words of the table are no secrets."""
    prose = [f"it is required and erforderlich in case {i}" for i in range(5)]
    more = [*prose, "passphrase: xqzvkwjfhtpl", "my password is QWZKJXVBNM here", "pin: 8391027465",
            "a password is required", "Pass: erforderlich", "login was 20240101",
            "password: hunter2#xQ9!kfLw", 'token: "abcdefgh", "user": "somebodyelse"']
    got = rows_by_id(secret_scan.scan_secrets(documents(spark, more)))
    spans = [got[len(texts()) + 5 + i].spans for i in range(8)]
    assert spans == ["guess:12:24", "guess:15:25", "guess:5:15", "", "", "", "assign:0:17,guess:17:26", "assign:0:16"]
    masked = rows_by_id(secret_scan.mask_secrets(documents(spark, more)))
    assert masked[len(texts()) + 5].text == "passphrase: [SECRET]"
    assert masked[len(texts()) + 11].text == "[SECRET][SECRET]"


def test_exact_dedup_hashes_survivors_only(spark):
    """In the plan the digest stands above the join that keeps repeated keys."""
    groups = exact_dedup.duplicate_groups(documents(spark))
    lines = groups._jdf.queryExecution().optimizedPlan().toString().splitlines()
    sha = next(i for i, line in enumerate(lines) if "sha2(" in line)
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    assert sha < semi and not any("sha2(" in line for line in lines[semi:])
    assert "_len" not in [c for c in groups.columns if c == "_prefix"]


def test_exact_dedup_of_awkward_rows(spark):
    """Null ids, an id with two texts, rows repeated with id and text, one length for all."""
    rows = [(None, "aa"), (1, "aa"), (1, "ab"), (1, "ab"), (2, "ab"), (3, "ac"), (3, "ac"), (None, "ad"), (None, "ad"),
            (4, None), (5, ""), (0, "ae"), (None, "ae")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in exact_dedup.drop_exact_duplicates(d).collect())
    assert got == [(False, 0, "ae"), (False, 1, "aa"), (False, 2, "ab"), (False, 3, "ac"), (False, 5, ""), (True, 0, "ad")]
    found = exact_dedup.exact_dedup(d).collect()
    assert len(found) == len(rows)
    for r in found:
        same = [(i, t) for i, t in rows if hashlib.sha256((t or "").encode()).hexdigest() == r.text_sha256]
        assert r.group_size == len(same) and r.keep_id == max((i for i, _ in same if i is not None), default=None)
    # one hot length, many texts
    many = spark.range(3000).selectExpr("id AS doc_id", "lpad(cast(id % 1000 AS string), 6, '0') AS text")
    assert sorted(r.doc_id for r in exact_dedup.drop_exact_duplicates(many).collect()) == list(range(2000, 3000))


def lambda_bodies(plan):
    """What stands inside the brackets of each lambda function of a plan."""
    for start in re.finditer(r"lambdafunction\(", plan):
        depth = 1
        for i in range(start.end(), len(plan)):
            depth += (plan[i] == "(") - (plan[i] == ")")
            if not depth:
                yield plan[start.end():i]
                break


def test_quality_filters_stay_above_the_statistics(spark):
    """No filter on a result is moved to where it would split texts inside a lambda."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    refs = quality_rules.language_references(quality_rules.reference_table(d))
    judged = quality_rules.quality_rules(d, references=refs)
    for condition in ("kept", "not base_failed", "char_distance > 0.2", "word_distance > 0.2", "n_repeat_words > 3"):
        lines = judged.where(condition)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        generate = next(i for i, line in enumerate(lines) if "Generate inline" in line)
        below = " ".join(lines[generate + 1:])
        assert "Filter" not in below
        for body in lambda_bodies(" ".join(lines)):
            assert "split(" not in body, condition


def test_quality_null_language_is_judged(spark):
    rnd = random.Random(5)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(40)]
    clean = [" ".join(rnd.choice(vocabulary) for _ in range(200)) for _ in range(60)]
    junk = " ".join("".join(rnd.choice("#%$&9{}") for _ in range(rnd.randint(3, 12))) for _ in range(120))
    rows = [(i, t, "en") for i, t in enumerate(clean)] + [(60, junk, None), (61, clean[0], None)]
    got = rows_by_id(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
    assert not got[60].kept and got[61].kept


def plain_cost(value, ranks):
    """Guess cost by trying every segmentation."""
    swapped, low = value.lower().translate(secret_scan.SWAPS), value.lower()
    per_char = math.log10(secret_scan._charset(value))
    ends = [list(secret_scan.segments_from(value, low, swapped, i, ranks)) for i in range(len(value))]

    def cuts(i):
        if i == len(value):
            yield 0, 0.0
            return
        for j, cost in [*ends[i], *[(j, per_char * (j - i)) for j in range(i + 1, len(value) + 1)]]:
            for k, rest in cuts(j):
                yield k + 1, cost + rest
    return min(cost + math.log10(math.factorial(k)) for k, cost in cuts(0))


def test_guess_cost_matches_plain_search():
    rnd = random.Random(8)
    ranks = secret_scan.RANK
    pieces = ["pass", "word", "love", "2001", "aaa", "qwer", "x9", "#", "é", "12", "Zz", "0day", "abab"]
    values = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 4)))[:12] for _ in range(60)]
    values += ["".join(rnd.choice("ab1A!é") for _ in range(rnd.randint(1, 9))) for _ in range(40)]
    for v in values:
        assert abs(secret_scan.guess_cost(v, ranks) - min(secret_scan.CEILING, plain_cost(v, ranks))) < 1e-9, v


def test_guess_cost_of_any_length():
    """The verdict does not flip with the length, and long values take little time."""
    cost = secret_scan.guess_cost
    for unit in ("a", "-", "password", "love", "=-"):
        costs = [cost(unit * n) for n in (8, 64, 400, 4000)]
        assert all(c < secret_scan.MIN_GUESS_LOG10 for c in costs), (unit, costs)
    rnd = random.Random(1)
    blob = "".join(rnd.choice("ABCDEFabcdef0123456789+/") for _ in range(2_000_000))
    assert cost(blob) == secret_scan.CEILING
    text = "token is " + blob + " end"
    assert secret_scan.guessed_spans(text, []) == [(9, 9 + len(blob), "guess")]


def test_dictionary_needs_support(spark):
    """A password mentioned once in prose, in copies of it, or as part of a longer
    string, is still one; a value with other letters is scored whole."""
    secret = "xqzvkwjfhtpl"
    rows = [f"my dog is called {secret} you know"] * 5 + [f"id 9{secret}-{i} 7#{secret}" for i in range(9)]
    rows += [f"ordinary überraschung number {i}" for i in range(6)]
    rows += [f"password: {secret}", "pwd: überraschung", "pwd: ordinary", "passcode is kéßq9ñzx!w"]
    got = rows_by_id(secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    spans = [got[len(rows) - 4 + i].spans for i in range(4)]
    assert spans == ["assign:0:22", "", "", "guess:12:22"]
    assert secret not in secret_scan.word_ranks(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))


def test_pii_context_of_long_words(spark):
    """Two words to the left, however long they are."""
    url = "https://example.org/" + "a" * 80
    piece = spark.createDataFrame([(f"see {url} mail: ",), (f"{url}/x {url}/y ",), ("x a b ",)], "p string")
    got = [r[0] for r in piece.select(pii._pattern(pii._left(piece.p))).collect()]
    assert got == [f"{url} mail:", f"{url}/x {url}/y", "a b"]
