"""The training-data operators on small cases, odd rows and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.llm import encoding, leakage, mixing, quality, queries, scannoise, splitting, truncation

PROSE = "The committee of the northern river reviews the annual report and returns the signed form to the office. It never omits the results of the second test within this part of the year."
BLOCKS = "block_id string, doc_id string, page_num int, text string, extraction_method string, block_kind string, block_role string, extra int"


def block(i, text, kind="text", method="ocr", page=0, doc="d", role="paragraph"):
    return (i, doc, page, text, method, kind, role, 1)


# --- quality ------------------------------------------------------------------


@pytest.mark.parametrize(
    "text",
    [
        "- apples and pears\n- plums\n- the long list of things that goes on\n- and ends here", "Name: Bob\nOffice: north\nPhone: 12345\nRemarks: none at all here\nOffice: south\nName: Ann",
        "Month,Rain,Sun\nmay,12,44\njune,15,33\njuly,10,80\naugust,9,77\nseptember,20,31\noctober,8", "(cid:12)(cid:33)" * 20, "word " * 40, ".a{margin:3px;color:#fff}.b{padding:2px;color:#000}.c{margin:3px;color:#fff}.d{padding:1px}",
    ],
)
def test_what_is_not_prose_has_no_sentences(text):
    assert quality.block_statistics(text)[5] > 800


@pytest.mark.parametrize("text", [PROSE, PROSE.replace(" ", "\n", 9), PROSE.replace("river", "rivÃ©r") + "\n[3]\nHeader Of Pages 2019"])
def test_prose_stays_prose_when_damaged(text):
    assert quality.block_statistics(text)[5] < 400


def test_not_prose_over_odd_rows(spark):
    rows = [block(f"p{i}", PROSE.replace("annual", f"annual number {i}")) for i in range(40)]
    rows += [block("bad", "- a b c d\n" * 20), block("bad", "- a b c d\n" * 20), block("none", None), block("empty", ""), block("short", "- a\n- b"), block("heading", "- a b c d\n" * 20, "heading"), block("null", "x;y;z " * 4000, None)]
    df = spark.createDataFrame(rows, BLOCKS)
    got = sorted(r["block_id"] for r in quality.not_prose(df).collect())
    assert got == ["bad", "null"]
    assert quality.not_prose(df.limit(0)).count() == 0


def test_scores_equal_brute_force(spark):
    import math

    rnd = random.Random(3)
    rows = [block(f"b{i}", " ".join(rnd.choice(["the", "of", "x1", "-", "River", "a."]) for _ in range(30))) for i in range(450)]
    s = quality.scored(quality.statistics(spark.createDataFrame(rows, BLOCKS))).collect()
    for r in s[:20]:
        same = [x for x in s if x["lang"] == r["lang"]]
        share = lambda rows: sum(x[k] >= r[k] for x in rows)
        want = 0.0
        for k in quality.STATS:
            tail = (share(same) + quality.PRIOR_TEXTS * share(s) / len(s)) / (len(same) + quality.PRIOR_TEXTS)
            want += -math.log(tail) * r[k] / 1000 * quality.WEIGHTS.get(k, 1.0)
        assert abs(want - r["outlier_score"]) < 1e-5


# --- splitting ----------------------------------------------------------------


def test_pieces_cover_overlap_and_fit(spark, tmp_path, monkeypatch):
    rnd = random.Random(5)
    text = "".join(rnd.choice(["word ", "wörd, ", "end. ", "\n", "\n\n", "漢字。", "x" * 30]) for _ in range(900))
    rows = [("a", "s", 1, text, None), ("b", "s", 1, text[:2000], "table_rows"), ("b", "s", 1, text[:2000], "table_rows"), ("e", "s", 1, "", "odd"), ("n", None, None, None, None), ("solid", "s", 2, "y" * 1000, "default")]
    df = spark.createDataFrame(rows, "chunk_id string, section_id string, page_start int, text string, chunk_strategy string")
    lim = spark.createDataFrame([("default", 300, 40), ("table_rows", 100, 10), ("table_rows", 100, 10), (None, 5, 1)], "chunk_strategy string, max_chars int, overlap_chars int")
    got = splitting.split_pieces(df, lim).orderBy("chunk_id", "piece_no").collect()
    for key, full, m, o in (("a", text, 300, 40), ("b", text[:2000], 100, 10), ("solid", "y" * 1000, 300, 40), ("e", "", 300, 40)):
        at = 0
        for r in (r for r in got if r["chunk_id"] == key):
            assert r["piece_chars"] <= m and r["piece_text"] == full[r["start"] : r["start"] + r["piece_chars"]]
            assert r["piece_no"] == 0 or at - r["start"] == o
            at = r["start"] + r["piece_chars"]
        assert at == len(full)
    assert sorted(r["chunk_id"] for r in splitting.oversized(df, lim).collect()) == ["a", "b", "solid"]
    assert splitting.split_pieces(df.limit(0), lim).count() == 0
    p = tmp_path / "giant.txt"
    p.write_bytes(text.encode())
    row = [(r["start"], r["piece_text"]) for r in got if r["chunk_id"] == "a"]
    for size in (512, 4096, 1 << 20):
        monkeypatch.setattr(splitting, "RANGE_CHARS", size)
        assert sorted((r["start"], r["piece_text"]) for r in splitting.split_pieces(df, lim).where("chunk_id = 'a'").collect()) == row
        f = splitting.split_files(spark, [(p.as_uri(), 300, 40, False)], range_bytes=size).orderBy("piece_no").collect()
        assert [(r["start"], r["piece_text"]) for r in f] == row


# --- scan noise ---------------------------------------------------------------


def test_damage_and_repair(spark):
    words = "the committee of northern river reviews annual report".split()
    clean = [block(f"n{i}", " ".join(words[i % 3 :] + words[: i % 3]) + ".", method="native", page=i) for i in range(40)]
    scan = [
        block("h", "the commit-\ntee of the river.", page=1), block("m", "the comm1ttee of thc northern rivcr.", page=2), block("p", "- 4 -", page=3), block("no", "- 4 -", page=7), block("x", "Annual Report of Rivers | 6\nthe river", page=5), block("y", "Annual Report of Rivers | 7", page=6),
        block("z", "Annua1 Rcport of Rivers", page=8), block("native", "the commit-\ntee", method="native", page=9), block("byp", "the commit-\ntee", method=None, page=10), block(None, "x-\ny"), block("null", None), block("empty", ""), block("none", "1", page=None),
    ]
    pages = spark.createDataFrame([("d", 10, True), ("d", 10, True), ("d", None, True), (None, 1, True), ("d", 9, None)], "doc_id string, page_num int, ocr_used boolean")
    df = spark.createDataFrame(clean + scan + scan[:1], BLOCKS)
    got = {(r["block_id"], r["noise_kind"]) for r in scannoise.damage(df, pages).collect()}
    assert got == {("h", "hyphenation"), ("byp", "hyphenation"), ("m", "misread"), ("p", "page_number"), ("x", "page_number"), ("x", "running_header"), ("y", "page_number"), ("y", "running_header"), ("z", "running_header"), ("z", "misread")}
    fixed = {r["block_id"]: r["repaired"] for r in scannoise.repaired(df, pages).collect()}
    assert fixed["h"] == "the committee of the river." and fixed["m"] == "the committee of the northern river." and fixed["p"] == "" and fixed["x"] == "the river"
    assert scannoise.damage(df.limit(0), pages.limit(0)).count() == 0


def test_weighted_distance_of_confusions():
    assert scannoise.weighted_distance("rnap", "map") == pytest.approx(0.3)
    assert scannoise.weighted_distance("exdudes", "excludes") == pytest.approx(0.3)
    assert scannoise.weighted_distance("cat", "cut") == 1
    assert scannoise.weighted_distance("", "ab") == 2


# --- encoding -----------------------------------------------------------------

TEXTS = ["Décision générale à côté de l’école « française ».", "Größe über „Straße“ – prüft", "Każdy dźwig południowy żółty", "Якщо перший лікар новий отримує звіт", "São comissão: ação é às três"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("wrong", ["cp1252", "cp1250", "cp437", "mac_roman", "cp1251"])
def test_utf8_read_as_another_encoding_comes_back(text, wrong):
    table = {b: u for u, b in encoding._TO_BYTES[wrong].items()}
    bad = "".join(c if c < "\x80" else chr(table.get(ord(c), ord(c))) for c in text.encode().decode("latin-1"))
    affected, restored, *_ = encoding.wrongly_decoded(bad)
    assert affected and restored == text


@pytest.mark.parametrize("text", TEXTS + ["At 20 °C the café – approx. 5 € – notes “this”.", "NAÇÃO E PREVISÃO", "© 2020 ½ naïve", "plain"])
def test_right_text_is_left_alone(text):
    assert not encoding.wrongly_decoded(text)[0]


def test_double_and_partial_and_lost(spark):
    twice = "É café".encode().decode("cp1252", "replace").encode("utf-8").decode("latin-1")
    part = TEXTS[3] + ". " + TEXTS[3].encode("cp1251").decode("cp1252", "replace")
    rows = [("twice", twice), ("part", part), ("lost", "La c�te"), ("null", None), ("empty", ""), ("long", "é" * 50_000), ("long2", "Ã©" * 20_000)]
    got = {r["block_id"]: r["restored"] for r in encoding.repaired(spark.createDataFrame(rows, "block_id string, text string")).collect()}
    assert set(got) == {"twice", "part", "lost", "long2"} and got["lost"] is None and got["long2"] == "é" * 20_000


# --- leakage ------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    filler = lambda n: [rnd.choice(vocab) for _ in range(n)]
    changed = list(passage[5:45])
    for i in range(8, 40, 10):
        changed[i] = "other"
    docs = {1: filler(50) + passage[10:30] + filler(50), 2: filler(40) + changed, 3: filler(200), 4: passage[:15] + filler(20), 5: [w.upper() + "," for w in passage], 6: [("é" if i % 25 == 0 else "") + w for i, w in enumerate(passage[:50])]}
    rows = [(k, " ".join(v), "x") for k, v in docs.items()] + [(7, None, "x"), (8, "", "x"), (9, " ".join(passage * 300), "x")]
    cases = spark.createDataFrame([("c", " ".join(passage), "q"), ("c", " ".join(passage), "q"), ("neg", None, "q"), ("tiny", "w1 w2", "q"), (None, "w1", "q")], "case_id string, passage string, query string")
    d = spark.createDataFrame(rows, "doc_id bigint, text string, case_id string")
    got = {(r["doc_id"], r["case_id"]): r["n_words"] for r in leakage.leaks(d, cases).collect()}
    assert set(got) == {(1, "c"), (2, "c"), (5, "c"), (6, "c"), (9, "c")} and got[1, "c"] >= 20 and got[5, "c"] == 60
    assert leakage.leaks(d, cases.limit(0)).count() == 0 and leakage.leaks(d.limit(0), cases).count() == 0
    report = {r["case_id"]: r["n_docs"] for r in leakage.leak_report(d, cases).collect()}
    assert report["c"] == 5 and report["neg"] == 0


def test_every_long_shared_run_shares_a_fingerprint():
    rnd = random.Random(2)
    for _ in range(200):
        run = [rnd.randrange(1, 2**63) for _ in range(leakage.K + leakage.WINDOW - 1)]
        import numpy as np

        def prints(pad):
            ids = np.array([rnd.randrange(1, 2**63) for _ in range(pad)] + run + [rnd.randrange(1, 2**63) for _ in range(pad)], np.uint64)
            return set(leakage.winnowed(ids, np.zeros(len(ids), int))[1].tolist())

        assert prints(rnd.randrange(9)) & prints(rnd.randrange(9))


def test_no_stretch_within_the_rate_is_lost():
    """Random stretches of 20 and more words with as many changed, dropped and added words as the rate allows, anywhere in them."""
    import numpy as np

    assert leakage.surest_run(20, 0.14) == leakage.K + leakage.WINDOW - 1
    rnd = random.Random(8)
    one = lambda: rnd.randrange(1, 2**32)
    for _ in range(1500):
        n = rnd.choice([20, 21, 22, 28, 29, 36, 43, 60, 90])
        part = [one() for _ in range(n)]
        changed = list(part)
        for i in sorted(rnd.sample(range(1, n - 1), int(0.14 * n)), reverse=True):
            kind = rnd.choice(["put", "put", "drop", "add"])
            changed[i : i + (kind != "add")] = [] if kind == "drop" else [one()]
        passage = [one() for _ in range(rnd.randrange(12))] + part + [one() for _ in range(rnd.randrange(12))]
        doc = [one() for _ in range(rnd.randrange(40))] + changed + [one() for _ in range(rnd.randrange(40))]
        prints = [leakage.winnowed(np.array(x, np.uint64), np.zeros(len(x), int)) for x in (doc, passage)]
        at = {}
        for j, h in zip(*map(np.ndarray.tolist, prints[1])):
            at.setdefault(h, []).append(j)
        hits = [(i, j) for i, h in zip(*map(np.ndarray.tolist, prints[0])) for j in at.get(h, ())]
        words, changes, _ = leakage.stretch(doc, passage, hits, 20, 0.14)
        assert words >= 20 and changes <= 0.14 * words


def test_chance_words_in_common_are_no_leak():
    rnd = random.Random(9)
    for _ in range(300):
        same = [rnd.randrange(1, 50) for _ in range(6)]
        passage, doc = ([rnd.randrange(1, 2**32) for _ in range(40)] for _ in range(2))
        passage[10:16] = doc[20:26] = same
        assert leakage.stretch(doc, passage, [(20, 10), (21, 11), (22, 12)], 20, 0.14)[0] == 0


def test_large_held_out_sets_are_joined_with_the_same_result(spark, monkeypatch):
    han = "".join(chr(0x4E00 + 7 * i) for i in range(30))
    d = spark.createDataFrame([(1, " ".join(f"a{i}" for i in range(30)) + " " + " ".join(f"b{i}" for i in range(30))), (2, "x " + han), (1, "another text"), (None, han)], "doc_id bigint, text string")
    c = spark.createDataFrame([("a", " ".join(f"a{i}" for i in range(30))), ("b", " ".join(f"b{i}" for i in range(30))), ("z", han)], "case_id string, passage string")
    want = [(1, "a"), (1, "b"), (2, "z")]
    assert sorted((r["doc_id"], r["case_id"]) for r in leakage.leaks(d, c).collect()) == want
    for name in ("BROADCAST_PRINTS", "BROADCAST_WORDS", "CASES_A_ROW"):
        monkeypatch.setattr(leakage, name, 1)
    assert sorted((r["doc_id"], r["case_id"]) for r in leakage.leaks(d, c).collect()) == want
    with pytest.raises(ValueError, match="equal words"):
        leakage.leaks(d, c, 8, 0.3)


def test_escapes_lead_to_the_original():
    cases = {"D&Atilde;&copy;cision du comit&Atilde;&copy;": "Décision du comité", "D\\u00c3\\u00a9cision": "Décision", "D&amp;Atilde;&amp;copy;cision": "Décision", "\\xc3\\xa9t\\xc3\\xa9 en ville": "été en ville"}
    for bad, text in cases.items():
        assert re.search(encoding.SUSPECT, bad) and encoding.wrongly_decoded(bad)[:2] == (True, text)
    for fine in ("R&amp;D costs", "caf&eacute; noir", "C:\\xab and \\u0041", "AT&T; more"):
        assert not encoding.wrongly_decoded(fine)[0]


def test_any_number_of_signs_is_read(spark):
    word = "administration of the 1nst1tut10n"
    rows = [block(f"n{i}", f"institution illumination {i} committee", method="native") for i in range(20)]
    rows += [block("s", "the 1n5t1tut10n and 1||um1nat10n", page=1), block("of", "0ur c0mm1ttee", page=2), block("two", "tk and 0f", page=3)]
    rows += [block(f"of{i}", "of the river of the town", method="native") for i in range(40)]
    df = spark.createDataFrame(rows, BLOCKS)
    got = {(r["w"], r["c"]) for r in scannoise.misreadings(scannoise.word_counts(df)).collect()}
    assert word and got == {("1n5t1tut10n", "institution"), ("1||um1nat10n", "illumination"), ("c0mm1ttee", "committee"), ("0f", "of")}


# --- mixing -------------------------------------------------------------------


def test_budgets_fill_siblings_first():
    leaves = [(("a", "en"), 100, 1), (("a", "fr"), 100, 1), (("b", "en"), 10, 2)]
    half = {("a",): 0.5, ("b",): 0.5}
    total, got = mixing.budgets(leaves, half)
    assert total == 40 and got[("b", "en")] == 20 and got[("a", "en")] + got[("a", "fr")] == 20
    total, got = mixing.budgets(leaves, half, 100)
    assert sum(got.values()) == 100 and got[("b", "en")] == 20
    assert mixing.budgets([], {("a",): 1.0}) == (0, {})
    assert sum(mixing.budgets(leaves, half, 10_000)[1].values()) == 220


def test_shortages_stay_in_the_domain_before_they_rise():
    leaves = [(("law", "en", "x"), 10, 1), (("law", "en", "y"), 90, 1), (("law", "fr", "x"), 100, 1), (("news", "en", "z"), 1000, 1)]
    weights = {("law",): 0.5, ("news",): 0.5, ("law", "en"): 1.0, ("law", "fr"): 1.0, ("law", "en", "x"): 3.0, ("law", "en", "y"): 1.0}
    _, got = mixing.budgets(leaves, weights, 200)
    assert got == {("law", "en", "x"): 10, ("law", "en", "y"): 40, ("law", "fr", "x"): 50, ("news", "en", "z"): 100}
    _, got = mixing.budgets(leaves, weights, 600)
    assert got == {("law", "en", "x"): 10, ("law", "en", "y"): 90, ("law", "fr", "x"): 100, ("news", "en", "z"): 400}


def test_shares_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    t = {r["source"]: r for r in spark.read.parquet(f"{sf}/mix_targets.parquet").collect()}
    got = queries.p7_shares(spark, sf).collect()
    has = [r["source"] for r in got if r["tokens"] > 0]
    scale = sum(t[s]["target_share"] for s in has)
    for r in got:
        want = t[r["source"]]["target_share"] / scale if r["source"] in has else 0.0
        assert r["actual_share"] == pytest.approx(want, abs=2e-3) and r["most_uses"] <= t[r["source"]]["max_repeats"]
    short = {r["source"]: r for r in queries.p7_short(spark, sf).collect()}
    assert sum(r["tokens"] for r in short.values()) > sum(r["tokens"] for r in got) and all(r["most_uses"] <= t[s]["max_repeats"] for s, r in short.items())


def test_mix_reaches_shares_and_respects_repeats(spark):
    rows = [(i, f"text number {i} of some words " * (1 + i % 3), "en" if i % 4 else None, " Big " if i % 5 else "small", 1) for i in range(100)] + [(500, "text number 3 of some words ", "en", "big", 1), (501, None, "en", "big", 1), (502, "x", None, None, 1), (503, "", "en", "big", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_tokens int")
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("absent", 0.1, 1), (None, 1.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t, seed=1).collect()
    assert [sorted(map(tuple, m))] == [sorted(map(tuple, mixing.mix(d, t, seed=1).collect()))]
    used = {s: sum(r["tokens_used"] for r in m if r["source"] == s) for s in ("big", "small")}
    assert used["big"] / sum(used.values()) == pytest.approx(0.6, abs=0.01)
    times = {}
    for r in m:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
        assert r["tokens_used"] <= r["n_tokens"]
    small = {i for i in range(100) if i % 5 == 0}
    assert all(n <= (3 if i in small else 1) for i, n in times.items()) and 500 not in times
    shares = {r["source"]: r["tokens"] for r in mixing.mix_shares(d, t, seed=1).collect()}
    assert shares["absent"] == 0 and shares["big"] == used["big"]
    assert mixing.mix(d.limit(0), t).count() == 0


# --- truncation ---------------------------------------------------------------


def test_truncated_by_limit_trace_and_word(spark):
    rnd = random.Random(4)
    vocab = [f"{a}{b}" for a in ("river", "office", "report", "garden", "winter") for b in ("side", "land", "work", "light", "stone")]
    sentence = lambda: " ".join(rnd.choice(vocab) for _ in range(8)).capitalize() + "."
    whole = lambda n: " ".join(sentence() for _ in range(n))
    rows = [(i, whole(3 + i % 9), "free", 1) for i in range(200)] + [(1000 + i, whole(40)[:500], "Cut ", 1) for i in range(40)]
    odd = [(2000, whole(3) + " And so it is ...", "free", 1), (2001, whole(3) + " Riverside offic…", "free", 1), (2002, whole(3) + " Riverside officeland reportwo", "free", 1), (2003, None, "free", 1), (2004, "", None, 1), (2005, whole(900) + " Riverside", None, 1), (2006, whole(2) + " offic�", None, 1), (2006, whole(2) + " offic�", None, 1), (2007, "   ", "free", 1)]
    d = spark.createDataFrame(rows + odd, "doc_id bigint, text string, source string, length int")
    got = {r["doc_id"]: r["reason"] for r in truncation.truncated(d).collect()}
    cut = {r[0] for r in rows[200:] if r[1][-1] != "."}
    assert {k for k, v in got.items() if v == "limit"} == cut
    assert {k for k in got if k >= 2000} == {2001, 2002, 2006} and not [k for k in got if k < 1000]
    lim = [(r["source"], r["length"]) for r in truncation.unexplained_lengths(d).where("measure = 'chars'").collect()]
    assert ("cut", 500) in lim
    rates = {r["source"]: r["n_cut"] for r in truncation.truncation_rates(d).collect()}
    assert rates["cut"] >= len(cut) - 1 and None in rates
    assert truncation.truncated(d.limit(0)).count() == 0


def test_word_verdicts_do_not_depend_on_the_size(spark):
    whole = "Both borders began beside brown bridges before big branches bent. " * 11 + "Column b is there. Column b."
    for copies in (10, 200):
        rows = [(i, f"{i} {whole}", "s") for i in range(copies)] + [(1000, f"{whole} Near the river they met b", "s")]
        d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
        assert {r["doc_id"]: r["reason"] for r in truncation.truncated(d).collect()} == {1000: "word"}
    rows = [(20_000 + i, f"{i} {whole}", "s") for i in range(10)]
    rows += [(21_000 + i, f"text {i} of them\nthe other b", None) for i in range(9)] + [(22_000 + i, f"text {i} of them\nthe part b", None) for i in range(20)]
    rows += [(23_000, "Xqz stands here. " + "word " * 900_000 + "ends.", "s"), (23_001, "They saw the office of old Xqz", "s")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").unionByName(spark.range(9000).selectExpr("id as doc_id", "concat('Some words stand here\nrow ', id) as text", "string(null) as source"))
    # nine of 9000 open texts share a line by chance, twenty share a formula; a name seen once in 900,000 words is as good as new
    assert {r["doc_id"] for r in truncation.truncated(d).where("reason = 'word'").collect()} == {*range(21_000, 21_009), 23_001}


# --- registered queries ---------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_with_the_columns_agreed(spark, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    found = {"p1_found": "block_id", "p2_found": "chunk_id", "p4_found": "block_id noise_kind", "p5_found": "block_id", "p6_found": "doc_id case_id", "p8_found": "doc_id"}
    rows = df.collect()
    if name in found:
        assert df.columns == found[name].split() and len(set(rows)) == len(rows)
