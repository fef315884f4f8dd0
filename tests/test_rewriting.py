"""In-line scrub, constant mask, dictionary rewrite, strategies."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import brute
from veilframe import STRATEGIES, Options, pseudonymize
from veilframe.detectors import (
    CREDENTIALS,
    IPV4,
    IPV6,
    MAC_ADDR,
    Detector,
    addresses_first,
    is_braceless,
    keyword_ahead,
    loose_profile,
    paths_first,
    pick,
    spares_tokens,
    strict_profile,
    with_detector,
    without_private,
)
from veilframe.functions import matching
from veilframe.functions.matching import has_match
from veilframe.functions.sql import register_functions
from veilframe.functions.tokens import TokenRule
from veilframe.operators import dictionary
from veilframe.operators import parts as parts_module
from veilframe.operators.dictionary import rewrite_with_dictionary
from veilframe.operators.rewriting import mask_kinds, scrub
from veilframe.shared import written

TOKENS = TokenRule()

# A masked "ip addr" log shows these two lines; the texts behind the tokens are known.
IP_ADDR = [
    ("    link/loopback 00:00:00:00:00:00 brd 00:00:00:00:00:00",
     "    link/loopback {{MAC-ADDR-8029b}} brd {{MAC-ADDR-8029b}}"),
    ("    inet 127.0.0.1/8 scope host lo", "    inet {{IPV4-e56ea}}{{FILE-DIR-4ff67}} scope host lo"),
    ("    inet 172.17.0.1/16 brd 172.17.255.255 scope global docker0",
     "    inet {{IPV4-7f870}}{{FILE-DIR-55b9c}} brd {{IPV4-8f989}} scope global docker0"),
    ("       valid_lft forever preferred_lft forever", "       valid_lft forever preferred_lft forever"),
    ("    inet6 ::1/128 scope host", "    inet6 ::1/128 scope host"),
]


def texts(df, col="line"):
    return [r[col] for r in df.orderBy("n").select(col).collect()]


def corpus(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "n int, line string")


def test_the_default_order_gives_the_known_log(spark):
    df = corpus(spark, [plain for plain, _ in IP_ADDR])
    for profile in (strict_profile(), addresses_first(loose_profile()[:4])):
        masked = scrub(df, "line", profile, TOKENS)
        assert texts(masked) == [expected for _, expected in IP_ADDR]


def test_strict_ipv6_leaves_words_alone(spark):
    lines = ["std::vector<ns::bit>", "inet6 fe80::20d:3aff:fe00:1/64 scope link", "2001:db8::1", "x ::ffff:1 y"]
    got = texts(scrub(corpus(spark, lines), "line", pick(strict_profile(), "IPV6"), TOKENS))
    assert (got[0], got[3]) == (lines[0], lines[3])
    assert got[1].startswith("inet6 {{IPV6-") and "{{IPV6-" in got[2]


NUMBERS = Detector("ZIP", r"\b[0-9]{5}\b", phase=3)
LETTERS = Detector("WORD", r"\b(?:IPV4|FILE|ab[0-9]*|e56ea)\b", phase=3)


def test_no_kind_is_found_inside_a_token(spark):
    """Tokens of any digits, and labels that hold the word sought."""
    lines = [f"10.1.{i // 200}.{i % 200} at 12345 IPV4 ab{i}" for i in range(400)] + ["e56ea 127.0.0.1 \ue141 12345"]
    df = corpus(spark, lines).withColumn("k", F.lit("k"))
    o = Options().with_kind(NUMBERS).with_kind(LETTERS)
    token = r"\{\{[A-Z0-9-]+-[0-9a-f]{5}\}\}"
    found = {
        "in line": scrub(df, "line", o.strict, TOKENS),
        "dictionary": pseudonymize(df, "k", "line", Options("LOW_LEVEL").with_kind(NUMBERS).with_kind(LETTERS)),
        "wide": rewrite_with_dictionary(df, "k", "line", o.loose, TOKENS, max_inline_entries=1),
    }
    for name, masked in found.items():
        for line in texts(masked)[:-1]:
            assert re.fullmatch(rf"{token} at {token} {token} {token}", line), (name, line)
    for line in texts(mask_kinds(df, "line", o.loose))[:-1]:
        assert line == "{{IPV4}} at {{ZIP}} {{WORD}} {{WORD}}"


WIDE = [
    Detector("SIX", r"[^ \n]{6}", phase=3),
    Detector("THREE", r"[^a-z \n]{3}", phase=3),
    Detector("SIGNS", r"[^\w\s]+", phase=3),
    Detector("FOUR", r"(?:[A-F0-9]|[^A-Z\n]){4}", phase=1, rank=9),
]


@pytest.mark.parametrize("wide", WIDE, ids=lambda d: d.kind)
def test_negated_classes_tear_no_token(spark, wide):
    lines = ["host 10.0.0.1 and /var/log/10.0.0.2/x password: 10.0.0.3", "a 02:00:11:00:00:0A {{X}} user=/a/b,c", "\ue141 10.0.0.1 é日", ""]
    df, profile = corpus(spark, lines), with_detector(strict_profile(), wide)
    # Private characters match no class while tokens are set.
    plain = [t.replace("\ue141", "") for t in lines]
    assert [t.replace("\ue141", "") for t in texts(scrub(df, "line", profile, TOKENS))][:2] == [brute.scrub(t, profile) for t in plain][:2]
    loose = with_detector(loose_profile(), wide)
    label = lambda kind, _: "{{" + kind + "}}"
    assert texts(mask_kinds(df, "line", loose))[:2] == [brute.scrub(t, loose, label) for t in plain][:2]
    register_functions(spark, profile, TOKENS, prefix="wide")
    assert texts(df.selectExpr("n", "wide_scrub(line) AS line")) == texts(scrub(df, "line", profile, TOKENS))


def test_texts_with_private_characters_are_rewritten_alike(spark):
    """Tokens are written in a block of characters that the text does not hold."""
    line = "host 10.0.0.1 user=x /a/b 12345 IPV4"
    profile = with_detector(with_detector(strict_profile(), NUMBERS), LETTERS)
    own = ["", "\ue100", "\ue141\ue17d", "\ue000\ue100\ue17f\ue180", "".join(chr(0xE000 + 128 * n + 45) for n in range(49)), "\uf8ff"]
    got = texts(scrub(corpus(spark, [f"{o} {line} {o}" for o in own]), "line", profile, TOKENS))
    assert got == [f"{o} {brute.scrub(line, profile)} {o}" for o in own]
    # A value of credentials takes such characters in and is hashed as it is.
    got = texts(scrub(corpus(spark, ["password=\ue120\ue141x"]), "line", profile, TOKENS))
    assert got == [brute.token("CREDENTIALS", "password=\ue120\ue141x")]


def test_kinds_that_spare_tokens():
    for profile in (strict_profile(), loose_profile()):
        assert all(spares_tokens(d, [d.kind for d in profile]) for d in profile)
    assert not any(spares_tokens(d, ["IPV4"]) for d in (*WIDE, NUMBERS, LETTERS))
    for keywords, kinds, spared in ((["user"], ["IPV4"], True), (["dir"], ["FILE-DIR"], False), (["dead"], ["IPV4"], False), (["user"], ["USER-ID"], False)):
        assert spares_tokens(pick(strict_profile(keywords), "CREDENTIALS")[0], kinds) == spared


def test_patterns_are_kept_from_private_characters():
    for plain in (r"\b(?:IPV4|seq)\b", r"[\w.\-]+/[a-z]{2}", r"(?i)\bx\d+\s*[:=]", r"a\.b\[c\]"):
        assert without_private(plain) == plain
    for wide in (r"[^ \n]", r"\S", r"\W", r".", r"[\S]", r"\P{Lu}", r"[^a[b]\n]", r"(?:x|[^\]\n])", r"\p{Co}"):
        assert without_private(wide) != wide
    with pytest.raises(ValueError, match="private"):
        Detector("PUA", "x\ue123")


def test_files_that_hold_only_a_custom_kind_are_rewritten(spark):
    df = corpus(spark, ["card 1234567812345678"]).withColumn("k", F.lit("k"))
    card = Detector("CARD", r"\b[0-9]{16}\b")
    for strategy in STRATEGIES:
        (line,) = texts(pseudonymize(df, "k", "line", Options(strategy).with_kind(card)))
        assert line.startswith("card {{CARD"), strategy
    with pytest.raises(ValueError, match="same kinds"):
        Options(strict=with_detector(strict_profile(), card))


def test_wide_dictionaries_take_long_lines(spark):
    """Places in a line are found at once, not by walking there."""
    lines = [" ".join(f"10.0.{i}.{j % 250} /p/{i}/{j}" for j in range(2000)) for i in range(3)]
    df = corpus(spark, lines).withColumn("k", F.lit("k"))
    wide = rewrite_with_dictionary(df, "k", "line", loose_profile(), TOKENS, max_inline_entries=1)
    assert texts(wide) == texts(rewrite_with_dictionary(df, "k", "line", loose_profile(), TOKENS, max_inline_entries=100_000))


def test_wide_dictionaries_cut_long_lines_into_windows(spark, monkeypatch):
    """Entries at window edges, shorter than a gram, of one gram, and null keys."""
    monkeypatch.setattr(dictionary, "_WINDOW", 40)
    lines = ["".join(f"/{'p' * (i % 9)}/{i} 10.{i}.0.{i} é {'/a' * 30} user=x{i},/b " for i in range(60)), "/b", "/é/日本/x 1.2.3.4", "", None, "/pp"]
    df = corpus(spark, lines).withColumn("k", F.when(F.col("n") > 0, "k"))
    wide = rewrite_with_dictionary(df, "k", "line", loose_profile(), TOKENS, max_inline_entries=1)
    assert texts(wide) == texts(rewrite_with_dictionary(df, "k", "line", loose_profile(), TOKENS, max_inline_entries=100_000))


def test_lines_look_up_their_distinct_words(spark, monkeypatch):
    """What is looked up grows with the words of a file, not with its lines."""
    lines = [f"host 10.0.{i % 5}.{i % 40} user=x{i % 30} /v/{i % 50}" for i in range(1200)]
    tables = {}

    def kept(df, name):
        tables[name] = written(df, name)
        return tables[name]

    monkeypatch.setattr(dictionary, "written", kept)
    df = corpus(spark, lines).withColumn("k", F.lit("k"))
    got = texts(rewrite_with_dictionary(df, "k", "line", loose_profile(), TOKENS))
    assert got == [e for e in brute.dictionary_rewrite([("k", t) for t in lines], loose_profile())]
    assert tables["words"].count() == 1 + 40 + 30 + 50
    assert tables["hits"].count() == 40 + 30 + 50


def test_words_that_hold_no_entry_by_their_characters_stay_at_home(spark, monkeypatch):
    """Prose is not looked up, and nothing is lost, be an entry with a digit,
    with a slash, or of letters only behind a keyword."""
    letters = "abcdefghij"
    prose = lambda i: " ".join(letters[i // 100 % 10] + letters[i // 10 % 10] + letters[i % 10] + c + "\u00e9." for c in "uvwxyz")
    held = [f"\t10.0.{i % 5}.{i % 90}  x" if i % 9 == 0 else f" /v/{prose(i)[:3]}" if i % 9 == 1 else f"  User\t{prose(i)[:3]}\n" if i % 50 == 2 else "" for i in range(1000)]
    lines = [f"{prose(i)}{held[i]}{prose(i + 500)} {held[i * 7 % 1000].strip()}" for i in range(1000)]
    tables = {}

    def kept(df, name):
        tables[name] = written(df, name)
        return tables[name]

    df = corpus(spark, lines).withColumn("k", F.lit("k"))
    want = [e for e in brute.dictionary_rewrite([("k", t) for t in lines], loose_profile())]
    monkeypatch.setattr(dictionary, "written", kept)
    for limit in (0, 1 << 25):
        got = texts(rewrite_with_dictionary(df, "k", "line", loose_profile(), TOKENS, broadcast_limit=limit))
        assert got == want
        assert tables["words"].count() < 2000
        assert tables["entries"].count() > 64
        assert tables["asked"].where(F.col("word").rlike("[0-9]")).count() > 0


def test_only_long_lines_are_cut_and_dealt(spark, monkeypatch):
    lines = [f"host 10.0.{i % 5}.{i} /v/{i}" for i in range(100)] + [" ".join(f"10.0.{i % 5}.{i}" for i in range(100))]
    tables = {}

    def kept(df, name):
        tables[name] = written(df, name)
        return tables[name]

    monkeypatch.setattr(dictionary, "written", kept)
    monkeypatch.setattr(dictionary, "_WINDOW", 60)
    df = corpus(spark, lines).withColumn("k", F.lit("k"))
    got = texts(rewrite_with_dictionary(df, "k", "line", loose_profile(), TOKENS))
    assert got == [e for e in brute.dictionary_rewrite([("k", t) for t in lines], loose_profile())]
    assert tables["windows"].select("_line").distinct().count() == 1


def test_paths_first_leaves_the_prefix_length(spark):
    masked = scrub(corpus(spark, ["inet 127.0.0.1/8"]), "line", paths_first(strict_profile()), TOKENS)
    assert texts(masked) == ["inet {{IPV4-e56ea}}/8"]


TRICKY = [
    "",
    None,
    "10.0.0.1",
    "10.0.0.1 10.0.0.1,10.0.0.2",
    "\x01 10.0.0.1 \x02 /a/b \x01\x02",
    "\x02/a\x01",
    "/a /b\n/c\n\n10.0.0.1\n",
    "password: /a/b then user=x",
    "{{IPV4-e56ea}} 127.0.0.1 }}/8",
    "$0 \\1 $1 /a$0 user=$0\\",
    "日本 10.0.0.1 /日本 /x",
    "fe80:%eth0 1:2:3:4:5:6:7:8 ::ffff:1.2.3.4",
    "token=" + "{{x}}" * 3,
]


@pytest.mark.parametrize("profile", [strict_profile, loose_profile])
def test_scrub_equals_plain_python(spark, profile):
    got = texts(scrub(corpus(spark, TRICKY), "line", profile(), TOKENS))
    expected = [None if t is None else brute.scrub(t, profile()) for t in TRICKY]
    assert got == expected


@pytest.mark.parametrize("out", [None, "masked"])
def test_large_cells_are_scrubbed_by_part(spark, out, rows_of, monkeypatch):
    """Parts travel as rows; what is beside the text, clashing names too, stays with it."""
    monkeypatch.setattr(parts_module, "DEALT_BYTES", 1)
    cells = ["\n".join(f"{i} 10.0.{i % 7}.{n} /srv/{i}" for i in range(n * 20)) for n in range(6)] + [None, "", "10.0.0.1", "\n" * 80]
    rows = [(t, n, f"r{n}", {"a": n}, n % 2, None) for n, t in enumerate([*cells, cells[3]])]
    df = spark.createDataFrame(rows, "value string, row int, rest string, part map<string,int>, `a.b` int, key string").repartition(3)
    o = lambda strategy: Options(strategy, num_parts=4, min_split_bytes=100)
    whole, parts = (pseudonymize(df, "key", "value", o(s), out) for s in ("IN_PLACE", "SAM"))
    assert parts.columns == whole.columns
    drop = lambda found: found.withColumn("part", F.to_json("part")).withColumnRenamed("a.b", "ab")
    assert rows_of(drop(parts)) == rows_of(drop(whole))


def test_sql_function_equals_scrub(spark):
    register_functions(spark, strict_profile(), TOKENS, prefix="tricky")
    df = corpus(spark, TRICKY)
    by_sql = df.selectExpr("n", "tricky_scrub(line) AS line")
    assert texts(by_sql) == texts(scrub(df, "line", strict_profile(), TOKENS))


def test_filters_on_masked_text_stay_small(spark):
    """Pushed below the projection, a filter repeats the rewrite, not its powers."""
    register_functions(spark, strict_profile(), TOKENS, prefix="small")
    df = corpus(spark, TRICKY)
    for masked in (
        scrub(df, "line", strict_profile(), TOKENS),
        mask_kinds(df, "line", loose_profile()),
        df.selectExpr("n", "small_scrub(line) AS line"),
    ):
        plan = masked.where("line LIKE '%IPV4%'")._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 80_000


def test_scrub_into_another_column_keeps_the_text(spark):
    row = scrub(corpus(spark, ["a 10.0.0.1"]), "line", strict_profile(), TOKENS, out="masked").first()
    assert (row["line"], row["masked"]) == ("a 10.0.0.1", "a " + brute.token("IPV4", "10.0.0.1"))


def test_mask_has_no_ids(spark):
    got = texts(mask_kinds(corpus(spark, ["10.0.0.1 /a 02:00:00:00:00:01 user: x ::1"]), "line", loose_profile()))
    assert got == ["{{IPV4}} {{FILE-DIR}} {{MAC-ADDR}} {{CREDENTIALS}} {{IPV6}}"]


def test_nothing_strict_is_left(spark, lines):
    masked = scrub(lines, "line", strict_profile(), TOKENS)
    for d in pick(strict_profile(), IPV4, MAC_ADDR):
        assert masked.where(has_match(F.col("line"), d)).count() == 0


def plain_rows(df):
    return [(r["file"], r["line"]) for r in df.collect()]


# Inline arrays or substring join; broadcast or salted shuffle joins.
LIMITS = [(20_000, 1 << 25), (20_000, 0), (2, 1 << 25), (1, 0)]


@pytest.mark.parametrize("inline, broadcast", LIMITS)
def test_dictionary_rewrite_equals_plain_python(spark, lines, inline, broadcast):
    got = rewrite_with_dictionary(
        lines, "file", "line", loose_profile(), TOKENS, "out",
        max_inline_entries=inline, broadcast_limit=broadcast,
    )
    rows = plain_rows(lines)
    expected = brute.dictionary_rewrite(rows, loose_profile())
    want = sorted(((f, t, e) for (f, t), e in zip(rows, expected, strict=True)), key=repr)
    assert sorted(((r["file"], r["line"], r["out"]) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("inline, broadcast", LIMITS)
def test_dictionary_of_a_hot_file(spark, inline, broadcast):
    """One file holds nearly all rows, many of them copies of one line."""
    hot = [("hot", f"10.0.{i % 7}.{i % 90} a/v{i % 5}/w" if i % 3 else "/v1/w 10.0.1.1") for i in range(600)]
    rest = [(f"f{i}", f"x 10.0.0.{i}") for i in range(40)]
    rows = hot + rest
    df = spark.createDataFrame(rows, "file string, line string").repartition(8)
    got = rewrite_with_dictionary(
        df, "file", "line", loose_profile(), TOKENS, "out",
        max_inline_entries=inline, broadcast_limit=broadcast,
    )
    expected = brute.dictionary_rewrite(rows, loose_profile())
    want = sorted((f, t, e) for (f, t), e in zip(rows, expected, strict=True))
    assert sorted((r["file"], r["line"], r["out"]) for r in got.collect()) == want


def test_one_character_segments_by_join(spark):
    digit = [Detector("DIGIT", "[0-9]")]
    df = spark.createDataFrame([("a", "1 2 34"), ("a", "5"), ("a", "none")], "file string, line string")
    for inline in (1, 100):
        got = rewrite_with_dictionary(df, "file", "line", digit, TOKENS, max_inline_entries=inline)
        t = {c: brute.token("DIGIT", c) for c in "12345"}
        # Tokens hold digits, but only the text as it was counts.
        assert "none" in {r["line"] for r in got.collect()}
        assert {r["line"] for r in got.collect()} >= {t["5"]}


PIECES = [
    *"0123456789abf./:{}'=- \x01\x02",
    *("10.0.0.", "1.2.3.4", "::", "fe80:", "02:00:11:", "/a", "/var/log", "user", "password: ", "token=", "%e"),
]


def random_rows(seed, n):
    """Lines made of pieces of segments, so that many nearly match."""
    rng = random.Random(seed)
    return [
        (rng.choice(["a", "a", "a", "b", "c"]), "".join(rng.choices(PIECES, k=rng.randint(0, 14))))
        for _ in range(n)
    ]


@pytest.mark.parametrize("profile", [strict_profile, loose_profile])
def test_random_lines_scrub(spark, profile):
    lines = [t for _, t in random_rows(1, 4000)]
    got = texts(scrub(corpus(spark, lines), "line", profile(), TOKENS))
    assert got == [brute.scrub(t, profile()) for t in lines]


@pytest.mark.parametrize("inline, broadcast", [LIMITS[0], LIMITS[2], LIMITS[3]])
def test_random_lines_dictionary(spark, inline, broadcast):
    rows = random_rows(2, 600)
    df = spark.createDataFrame(rows, "file string, line string")
    got = rewrite_with_dictionary(
        df, "file", "line", loose_profile(), TOKENS, "out",
        max_inline_entries=inline, broadcast_limit=broadcast,
    )
    expected = brute.dictionary_rewrite(rows, loose_profile())
    want = sorted((f, t, e) for (f, t), e in zip(rows, expected, strict=True))
    assert sorted((r["file"], r["line"], r["out"]) for r in got.collect()) == want


def test_same_segment_same_token_across_files(spark):
    df = spark.createDataFrame([("a", "10.0.0.1"), ("b", "x 10.0.0.1")], "file string, line string")
    got = {r["line"] for r in pseudonymize(df, "file", "line", Options(strategy="LOW_LEVEL")).collect()}
    t = brute.token("IPV4", "10.0.0.1")
    assert got == {t, f"x {t}"}


def test_in_line_strategies_agree(spark, lines, rows_of):
    results = [
        rows_of(pseudonymize(lines, "file", "line", Options(strategy=s, min_split_bytes=5, num_parts=3)))
        for s in ("IN_PLACE", "SAM", "SIP", "HYBRID_SPLIT")
    ]
    assert all(r == results[0] for r in results)


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_strategies_keep_rows_and_clean_lines(spark, lines, strategy):
    got = pseudonymize(lines, "file", "line", Options(strategy=strategy, threshold=3)).collect()
    assert len(got) == lines.count()
    assert {r["line"] for r in got if r["file"] == "b"} == {"nothing to see", None}
    assert all("10.0.0.12" not in (r["line"] or "") for r in got)


@pytest.mark.parametrize("broadcast", [1 << 25, 0])
def test_hybrid_takes_the_route_of_each_file(spark, lines, broadcast):
    """``a`` has 15 distinct segments, the unnamed file 1, ``b`` none."""
    rows = plain_rows(lines)
    by_dictionary = brute.dictionary_rewrite(rows, loose_profile())
    by_line = [None if t is None else brute.scrub(t, strict_profile()) for _, t in rows]
    for threshold, expected_a in ((2, by_line), (100, by_dictionary)):
        want = [e if f == "a" else d for (f, _), e, d in zip(rows, expected_a, by_dictionary, strict=True)]
        options = Options(threshold=threshold, broadcast_limit_bytes=broadcast)
        got = pseudonymize(lines, "file", "line", options, out="out").collect()
        assert sorted(map(repr, (r["out"] for r in got))) == sorted(map(repr, want)), threshold


def test_custom_detector(spark):
    card = Detector("CARD", r"\b[0-9]{16}\b", phase=1, rank=9)
    profile = with_detector(strict_profile(), card)
    df = corpus(spark, ["card 1234567890123456 at 10.0.0.1"])
    expected = f"card {brute.token('CARD', '1234567890123456')} at {brute.token('IPV4', '10.0.0.1')}"
    assert texts(scrub(df, "line", profile, TOKENS)) == [expected]
    assert texts(mask_kinds(df, "line", profile)) == ["card {{CARD}} at {{IPV4}}"]


@pytest.mark.parametrize(
    "kwargs",
    [
        {"strategy": "POPO"},
        {"threshold": 0},
        {"threshold": 1.5},
        {"min_split_bytes": 0},
        {"min_split_bytes": -4},
        {"num_parts": 0},
        {"max_inline_entries": 0},
        {"broadcast_limit_bytes": -1},
        {"token_width": 0},
        {"digest": "none"},
    ],
)
def test_bad_options_are_rejected(kwargs):
    with pytest.raises(ValueError):
        Options(**kwargs)


def test_default_options():
    o = Options()
    assert (o.strategy, o.salt, o.threshold, o.min_split_bytes) == ("HYBRID", "1234", 200, 5 * 1024 * 1024)
    assert (o.ignore_hint, o.remove_original) == (None, False)


LETTERS_FIVE_SIX = [LETTERS, Detector("FIVE", r"\b[0-9]{5}\b", phase=3), Detector("SIX", r"[^ \n]{6}", phase=3, rank=1)]


def _random_lines(n):
    pieces = ["10.0.0.1", "/etc/x", "/24", " ", " ", "inet", "IPV4", "FILE", "e56ea", "12345", "user=", "password: ", "fe80::1", "fe80:%e",
              "02:00:00:00:00:0A", "1:2:3:4:5:6:7:8", "{", "}", "{{", "}}", "{{IPV4-e56ea}}", "\x1a", "", "é", ",", "$0", "\\"]
    rnd = random.Random(11)
    return ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("extra", LETTERS_FIVE_SIX, ids=lambda d: d.kind)
def test_lines_are_sealed_only_for_braces_or_marks(spark, monkeypatch, extra):
    profile = with_detector(strict_profile(), extra)
    lines = ["10.0.0.1/8 at /etc/x user=bob ab1 12345", "{ab1} } {10.0.0.1}", "nothing", "", "é 10.0.0.1"]
    expected = texts(scrub(corpus(spark, lines), "line", profile, TOKENS))
    monkeypatch.setattr(matching, "seal", lambda text, chosen: F.raise_error(F.lit("sealed")).cast("string"))
    assert texts(scrub(corpus(spark, lines), "line", profile, TOKENS)) == expected
    for line in ("{{ 10.0.0.1", "\x1a 10.0.0.1", "\ue17b 10.0.0.1"):
        with pytest.raises(Exception, match="sealed"):
            texts(scrub(corpus(spark, [line]), "line", profile, TOKENS))


@pytest.mark.parametrize("rewrite", [lambda df, p: scrub(df, "line", p, TOKENS), lambda df, p: mask_kinds(df, "line", p)], ids=["token", "mask"])
def test_readable_and_sealed_texts_are_rewritten_alike(spark, monkeypatch, rewrite):
    df = corpus(spark, _random_lines(400))
    profile = strict_profile()
    for extra in LETTERS_FIVE_SIX:
        profile = with_detector(profile, extra)
        mixed = texts(rewrite(df, profile))
        with monkeypatch.context() as patch:
            patch.setattr(matching, "holds_usual", lambda text: F.lit(True))
            assert texts(rewrite(df, profile)) == mixed


def test_patterns_that_show_no_brace():
    for regex in (r"\b(?:IPV4|inet|seq)\b", r"\b[0-9]{5}\b", "a|b", r"[A-Z]+\.x", r"(a|b){2,}"):
        assert is_braceless(regex), regex
    for regex in ("[^ ]{6}", "a.", r"a\{", "[a-~]", "a*", "a?", "(?i)a", "(?=a)b", "(?<!a)b", "a|", "(|a)", "(a|)", "|a", r"\S", "a{0,2}", "()", r"\W", "^a", "[ -{]", r"\b", r"(?:a|\b)", r"\b(\B)"):
        assert not is_braceless(regex), regex


def test_looking_ahead_hides_no_match(spark):
    df = corpus(spark, [*_random_lines(400), "::1", "a::", "fe80:%eth0", "1:2:3:4:5:6:7::", "::ffff:1.2.3.4", "1.1.1.1", "PWD x", "API_KEY=1"])
    for d in strict_profile() + loose_profile():
        found = texts(df.select("n", matching.matches(F.col("line"), d).alias("line")))
        bare = Detector(d.kind, d.regex)
        assert found == texts(df.select("n", matching.matches(F.col("line"), bare).alias("line")))
        assert d.kind not in (IPV4, IPV6, CREDENTIALS) or d.sought_regex.startswith("(?=")
    assert keyword_ahead(["a?pi"]) is None and keyword_ahead(["pwd", "xpwd"]) == "[PXpx]"
