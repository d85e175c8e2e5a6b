import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.llm import truncation
from treeloom.llm.features import document_features, hilbert_keys, project, token_counts
from treeloom.llm.mixing import Cell, exact_budget, mix, rake, source_totals
from treeloom.llm.packing import Packer, fill, pack, pieces
from treeloom.llm.truncation import FACTS, aligned_by_index, aligned_cut, corpus_counts, rates, read_units, strip_marker, truncated


def test_hilbert_neighbours_are_adjacent():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(side**3))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_features_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, " \n"), (5, "wort " * 200_000), (None, "x"), (1, "hello world"), (6, "<|endoftext|>")], "doc_id bigint, text string").withColumns({"curve": F.lit("clash"), "tokens": F.lit("clash")})
    got = document_features(docs).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 1, 4, 5, 6]
    assert {r.tokens for r in got if r.doc_id == 1} == {2} and next(r.tokens for r in got if r.doc_id == 5) >= 200_000
    assert token_counts(["<|endoftext|>"])[0] > 1
    odd = ["x" * 5000, " " * 5000, "a" + " " * 5000 + "b", "a  b\n\n\nc\t d", "é漢字 ñ don't I'll 12345 ---", "\u200b\ufeff", "🙂🙂 x", "\n", "a \n"]
    assert token_counts(odd) == token_counts(odd, "/opt/tokenizers/byte_bpe_50k.json")
    assert token_counts([" " * 1_000_000, "a" + " " * 1_000_000 + "b", "x" * 1_000_000])[0] > 0
    assert np.isfinite(project(["", "a b", "..."])).all()


def test_packer_never_overfills():
    rng = np.random.default_rng(2)
    packer, used = Packer(100), {}
    for size in rng.integers(1, 101, 3000):
        n = packer.place(int(size))
        used[n] = used.get(n, 0) + int(size)
        assert n >= packer.count - 21
        packer.leave(packer.count - 20)
    assert max(used.values()) <= 100
    assert pieces(250, 100) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)] and pieces(100, 100) == [(0, 0, 100)]


def test_packing_keeps_every_token_once(spark):
    rng = np.random.default_rng(3)
    sizes = [int(s) for s in rng.integers(0, 400, 3000)]
    features = spark.createDataFrame([(i, s, int(rng.integers(0, 1 << 30))) for i, s in enumerate(sizes)] + [(None, 5, 5), (0, sizes[0] or 1, 7)], "doc_id bigint, tokens bigint, curve bigint").withColumn("pid", F.lit("clash"))
    specs = spark.createDataFrame([("s", 64), ("l", 512), ("bad", 0), (None, 5), ("s", 64)], "spec_name string, capacity_tokens int")
    packed = pack(features, specs, stretches=3)
    rows = packed.collect()
    total = sum(sizes) + 5 + (sizes[0] or 1)
    for name, cap in (("s", 64), ("l", 512)):
        own = [r for r in rows if r.spec_name == name]
        assert sum(r.tokens for r in own) == total
        load = {}
        for r in own:
            load[r.container_id] = load.get(r.container_id, 0) + r.tokens
        assert max(load.values()) <= cap
        assert all(sizes[r.doc_id] > cap for r in own if r.piece_no > 0)
        assert total / (len(load) * cap) > 0.97
    assert {r.spec_name for r in rows} == {"s", "l"}
    assert {r.spec_name: r.tokens for r in fill(packed, specs).collect()} == {"s": total, "l": total}
    assert pack(features, specs.limit(0)).count() == 0 and pack(features.limit(0), specs).count() == 0


def test_containers_hold_neighbours_on_the_curve(spark):
    rng = np.random.default_rng(7)
    n = 20_000
    features = spark.createDataFrame([(i, int(s), i) for i, s in enumerate(rng.integers(1, 200, n))], "doc_id bigint, tokens bigint, curve bigint")
    specs = spark.createDataFrame([("s", 64), ("m", 512), ("l", 2048)], "spec_name string, capacity_tokens int")
    for stretches in (1, 4):
        packed = pack(features, specs, stretches=stretches)
        apart = packed.groupBy("spec_name", "container_id").agg(F.stddev_pop("doc_id").alias("apart")).groupBy("spec_name").agg(F.avg("apart").alias("apart"))
        # random containers are 0.289 n apart
        assert all(r.apart < 0.0289 * n for r in apart.collect())
        assert all(r.fill > 0.99 for r in fill(packed, specs).collect())


def test_raking_meets_sources_and_caps():
    cells = [Cell(s, lang, t, tokens) for s, lang, t, tokens in [("a", "en", 0, 100.0), ("a", "de", 1, 50.0), ("b", "en", 0, 10.0), ("b", "de", 1, 20.0)]]
    cap = {"a": 1, "b": 4}
    share = {"a": 0.6, "b": 0.4}
    have = {"a": 150.0, "b": 30.0}
    totals = source_totals(have, share, cap, 180.0)
    assert totals == {"a": pytest.approx(108), "b": pytest.approx(72)}
    weight = rake(cells, totals, cap)
    assert weight[:2].sum() == pytest.approx(108) and weight[2:].sum() == pytest.approx(72)
    assert (weight <= np.array([c.tokens * cap[c.source] for c in cells]) + 1e-9).all()
    assert exact_budget(have, share, cap) == pytest.approx(250)
    assert exact_budget({}, share, cap) == 0


def test_no_document_is_repeated_beyond_its_cap(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"s{i % 3}", "en", int(rng.integers(0, 16)), int(rng.integers(1, 3000))) for i in range(90)]
    features = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic int, tokens bigint")
    targets = spark.createDataFrame([("s0", 0.7, 2), ("s1", 0.2, 1), ("s2", 0.1, 3)], "source string, target_share double, repeat_cap int")
    for budget in ("exact", None, 10_000_000):
        chosen, _ = mix(features, targets, budget=budget)
        assert all(r.copies <= {"s0": 2, "s1": 1, "s2": 3}[r.source] for r in chosen.collect())


def test_mix_reaches_shares(spark):
    rng = np.random.default_rng(4)
    rows = [(i, ("Big ", "mid", "tiny")[int(rng.choice(3, p=[0.7, 0.27, 0.03]))], ("en", "de", None, "xx")[i % 4], i % 5, int(rng.integers(1, 300))) for i in range(6000)]
    rows += [(9000, None, "en", 0, 10), (9001, "other", "en", 0, 10), (9002, "mid", "en", 0, 0), (None, "mid", "en", 0, 9)]
    features = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, topic int, tokens bigint").withColumn("bucket", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.1, 2), ("gone", 0.1, 3)], "source string, target_share double, repeat_cap int")
    chosen, shares = mix(features, targets, budget=None)
    got = {r.source: r for r in shares.collect()}
    cap = {"big": 1, "mid": 2, "tiny": 2}
    assert all(r.copies <= cap[r.source] for r in chosen.collect())
    budget = sum(r.available_tokens for r in got.values())
    assert got["big"].tokens == pytest.approx(0.5 * budget, rel=0.01) and got["mid"].tokens == pytest.approx(0.3 * budget, rel=0.01)
    assert got["tiny"].tokens == 2 * got["tiny"].available_tokens and got["gone"].tokens == 0
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1)
    exact = {r.source: r for r in mix(features, targets.where("source <> 'gone'"), max_languages=1)[1].collect()}
    assert all(r.actual_share == pytest.approx(r.target_share, abs=0.01) for r in exact.values())
    assert mix(features.limit(0), targets)[0].count() == 0 and mix(features, targets.limit(0))[1].count() == 0


CUT = [
    "A first one. The second is going on and th\ufffd",
    "Text with code:\n\n```python\nfor x in y:\n    print(x)",
    "See <a href=\"http://x.example/a/12345\">he",
    "<pre><code>f(1)</code></pr",
    "One thing (see the other",
    "Escaped half\\u00",
    "Entity half &quo",
    "It stops in here … (leer más)",
    "Then it [...]",
]
WHOLE = [
    "A sentence. Another one!",
    "Code:\n\n```\nrun\n```",
    "All is good :)",
    "See [this](http://x.example/a/12345)",
    "<pre><code>f(1)</code></pre>",
    "He said \"[...] and so on.\" I agree.",
    "A sentence ends. [...]",
]


def test_endings_that_need_no_counts():
    assert [read_units(t)[1] for t in CUT] == ["cut"] * len(CUT)
    assert [read_units(t)[1] for t in WHOLE] == ["closed"] * len(WHOLE)
    for t in ("", " ", "\n", "```", "....", "x" * 1_000_000, "(" * 5000):
        read_units(t)


def test_alignment():
    words = [f"word{i}" for i in range(60)]
    long = " ".join(words) + ". The end."
    assert aligned_cut(" ".join(words[:55]), long) == "cut"
    assert aligned_cut(" ".join(words[:54]) + " word5", long) == "cut"
    assert aligned_cut(" ".join(words) + ".", long) == "end"
    assert aligned_cut(" ".join(words[:15]), long) == "cut" and aligned_cut(" ".join(words), long) == "end"
    assert aligned_cut(" ".join(words[:20]), " ".join(words[:20]) + " ") == ""
    assert aligned_cut("nothing like it at all here", long) == "" and aligned_cut("", long) == ""


def corpus(spark):
    nouns = ["table", "index", "cache", "buffer", "record", "filter"]
    texts = []
    for i in range(240):
        a, b = nouns[i % 6], nouns[(i * 7 + 1) % 6]
        texts.append(f"You have to open the {a} before you close the {b} {i}. If the {b} is gone, nothing happens to the {a}.")
        if i % 3 == 0:
            texts.append(f"see the {a} page")
        if i % 4 == 0:
            texts.append("Hm, no idea then...")
        if i % 5 == 0:
            texts.append(f"Steps:\n\n1. open the {a}\n2. close the {b}")
    return texts


def test_truncated_by_counts_over_all_documents(spark):
    whole = corpus(spark)
    cut = ["You have to open the table before you close the", "You have to open the ind", "Steps:\n\n1. open the table\n2. close the", "If the cache is gone, nothing happens to", "If the buffer..."]
    rows = [(i, t, "Src " if i % 2 else "src") for i, t in enumerate(whole)] + [(10_000 + i, t, None) for i, t in enumerate(cut)]
    rows += [(20_000, None, None), (20_001, "", None), (20_002, " \u00a0\n", None), (None, "Fine.", None), (0, whole[0], "src")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"score": F.lit("clash"), "kind": F.lit(1), "band": F.lit(2)})
    found = truncated(docs)
    assert {r.doc_id for r in found.where("is_cut").collect()} == {10_000 + i for i in range(len(cut))}
    assert found.count() == len(whole) + len(cut) + 1
    rate = {r.source: (r.texts, r.cut) for r in rates(docs, found).collect()}
    assert set(rate) == {"src", None} and rate[None][1] == len(cut) and rate["src"][1] == 0
    assert truncated(docs.limit(0)).count() == 0
    nameless = rates(docs.where("doc_id IS NULL"), found).collect()
    assert [(r.source, r.texts, r.cut) for r in nameless] == [(None, 1, 0)]


def test_longer_words_are_counted_however_rare_and_long(spark):
    long = "x" * 70
    rows = [("count", k, n) for k, n in (("frobnicate", 1), ("frobber", 1), (long + "ab", 1), (long + "cd", 2), ("x" * 64 + "y", 5))]
    facts = spark.createDataFrame([(t, None, "word", k, n, 0, None, None, None) for t, k, n in rows] + [("ending", 1, "longer word", long, None, None, "bare", "text", None)], FACTS)
    got = {r.key: r.n for r in corpus_counts(facts).where("stat = 'longer word'").collect()}
    assert got["frob"] == 2 and got["frobb"] == 1 and got[long] == 3 and got["x" * 64] == 8


def test_markers():
    for text, body in [("a b … (Leer Más)", "a b"), ("a [...] [more]", "a"), ("…", ""), ("a… b", "a… b"), ("İ [CUT]", "İ")]:
        assert strip_marker(text) == (body, body != text)


def test_strongly_cut_copies_are_found(spark):
    rng = np.random.default_rng(11)
    rows, n = [], 200
    for k in range(n):
        words = [f"k{k}w{i}z{r}" for i, r in enumerate(rng.integers(0, 1_000_000, 160))]
        copy = list(words)
        for i in rng.integers(5, 15, 1):
            copy[i] = "changed" if k % 2 else copy[i]
        rows += [(2 * k, " ".join(copy[: rng.integers(50, 120)])), (2 * k + 1, " ".join(words) + ".")]
    found = {r.doc_id: r for r in truncated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert sum(found[2 * k].aligned == "cut" for k in range(n)) >= 0.95 * n
    assert not any(found[2 * k + 1].is_cut for k in range(n))


def test_strongly_cut_copies_of_a_large_bucket_are_found(spark):
    words = [f"w{i}q" for i in range(40)]
    rows = [(i, " ".join(words) + f" so {'abcdefghij'[i % 10]}{i} " + " ".join(f"v{i}x{j}" for j in range(80)) + " ends.") for i in range(60)]
    rows += [(1000 + i, rows[i][1].split(" ends")[0].rsplit(" ", 60)[0]) for i in range(0, 60, 3)]
    found = {r.doc_id: r for r in truncated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(found[1000 + i].aligned == "cut" for i in range(0, 60, 3)) and not any(found[i].is_cut for i in range(60))


@pytest.mark.parametrize("copies", [1, 50])
def test_an_aligned_end_is_no_cut(spark, copies):
    words = " ".join(f"w{i % 37}x{i}" for i in range(60))
    whole = [(20_000 + i, f"{words} see the\n\nThe next one goes on here {'abcdefghij'[i % 10]}{i} and ends.") for i in range(copies)]
    texts = [(i, t) for i, t in enumerate(corpus(spark))]
    short = [(10_000, f"{words} see the")]
    found = {r.doc_id: r for r in truncated(spark.createDataFrame(texts + short, "doc_id bigint, text string")).where("doc_id >= 10000").collect()}
    assert found[10_000].is_cut
    found = {r.doc_id: r for r in truncated(spark.createDataFrame(texts + short + whole, "doc_id bigint, text string")).where("doc_id >= 10000").collect()}
    assert found[10_000].aligned == "end" and (found[10_000].score < 0.5 or copies > 1) and not any(r.is_cut for r in found.values())


def test_longer_near_copy_shows_the_cut(spark):
    words = " ".join(f"w{i % 37}x{i}" for i in range(80))
    rows = [(1, words + " tail goes on and ends here."), (2, words + " tail"), (3, "Another text that is whole.")]
    found = {r.doc_id: r for r in truncated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[2].aligned == "cut" and found[2].is_cut and not found[1].is_cut and not found[3].is_cut


def test_many_copies_with_one_beginning(spark):
    words = " ".join(f"w{i % 41}y{i}" for i in range(80))
    rows = [(i, words + f" and then variant {'abcdefghij'[i % 10]}{i} comes to its end.") for i in range(60)] + [(100, words + " and then var"), (101, words + " and then … (leer más)")]
    found = {r.doc_id: r for r in truncated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[100].aligned == "cut" and found[101].aligned == "cut"
    assert not any(found[i].is_cut for i in range(60))


def test_cut_copies_of_a_large_bucket_that_differ_before_the_cut(spark):
    words = [f"w{i % 41}y{i}" for i in range(80)]
    shared = " ".join(words)
    rows = [(i, f"{shared} and then variant {'abcdefghij'[i % 10]}{i} comes to its end.") for i in range(60)]
    other = words[:20] + ["changed"] + words[21:]
    rows += [(100, " ".join(other) + " and then var"), (101, shared.replace("w5y5 ", "W5Y5  ") + " and then")]
    # the next text in order has the same body, and the one after goes on for too long to be a near-copy
    rows += [(102, shared + " with more of"), (103, shared + " with more of [more]"), (104, shared + " with more of it " + " ".join(f"z{i}" for i in range(60)) + "."), (105, shared + " with more of these zebras here.")]
    found = {r.doc_id: r for r in truncated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [found[i].aligned for i in (100, 101, 102, 103)] == ["cut"] * 4
    assert not any(found[i].is_cut for i in [*range(60), 104, 105])


def test_cut_copies_of_a_large_bucket_with_another_or_a_short_beginning(spark):
    words = [f"w{i}q" for i in range(22)]
    rows = [(i, " ".join(words) + f" so {'abcdefghij'[i % 10]}{i}.") for i in range(60)]
    rows += [(100, " ".join(words[:20])), (101, "W0Q  " + " ".join(words[1:21]))]
    assert len(rows[-2][1]) < 120
    found = {r.doc_id: r for r in truncated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found[100].aligned == "cut" and found[101].aligned == "cut"
    assert not any(found[i].is_cut for i in range(60))


def test_copies_of_a_cut_text_are_no_evidence_for_each_other(spark):
    cut = ["The reader goes through it slowly. Zebra quokka wombat runs towards glimmering fjords", "It starts like this:\n\n    first(1)\n    second(frobnicate", "He has asked for it before. Quagga yonder went away..."]
    verdicts = []
    for copies in (1, 10):
        rows = list(enumerate(corpus(spark))) + [(10_000 + 100 * k + c, t) for k, t in enumerate(cut) for c in range(copies)]
        found = truncated(spark.createDataFrame(rows, "doc_id bigint, text string")).where("doc_id >= 10000").collect()
        verdicts.append({(r.doc_id // 100, r.is_cut, round(r.score, 9)) for r in found})
    assert verdicts[0] == verdicts[1] and len(verdicts[0]) == 3


def test_unfinished_tag_that_began_far_back():
    data = "data:image/png;base64," + "iVBORw0KGgo" * 60
    cut = [f'See <img src="{data}', f"See <a class='x' title=\"{'word ' * 90}", f'See <img alt="a" src="{data}" wid', f"See <img src={data}"]
    assert [read_units(t)[1] for t in cut] == ["cut"] * 4
    prose = " and it goes on with words" * 30 + "."
    assert [read_units(t + prose)[1] for t in ("If a <b then", "for (i = 0; i <n; i++) x = 1;")] == ["closed"] * 2
    read_units("<a" + " b=c" * 100_000 + " <")
    read_units("<a" + " b" * 100_000)


def test_cut_copies_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(200):
        words = [f"k{k}w{i}z{n}" for i, n in enumerate(rng.integers(0, 1_000_000, 104))]
        rows += [(2 * k, " ".join(words[:84])), (2 * k + 1, " ".join(words) + ".")]
    found = {r.doc_id: r for r in truncated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len([k for k in range(200) if found[2 * k].aligned != "cut"]) <= 1  # 0.04 % are expected to escape
    assert not any(found[2 * k + 1].aligned for k in range(200))


def unlike_texts_with_one_ending():
    """(rep, text, asks): texts that go on after the same words, unlike before them, and cut ones, some of them copies with a few words changed."""
    rng = np.random.default_rng(3)
    opening, ending = " ".join(f"o{i}q" for i in range(16)), "have a look at the children"
    rows = []
    for i in range(150):
        words = [f"t{i}w{j}" for j in range(rng.integers(20, 60))]
        rows.append((i, f"{opening} {' '.join(words)} {ending} first of all, {' '.join(f't{i}v{j}' for j in range(30))}.", False))
        if i % 3 == 0:
            for j in rng.integers(0, len(words), i % 5):
                words[j] = "changed"
            rows.append((1000 + i, f"{opening} {' '.join(words)} {ending}", True))
    for i in range(100):
        rows.append((2000 + i, f"{opening} {' '.join(f's{i}w{j}' for j in range(rng.integers(4, 60)))} {ending}"[: -1 - i % 2], True))
    # a boilerplate that many texts share as a whole, and an end beside it
    shared = " ".join(f"b{j}q" for j in range(40))
    rows += [(3000 + i, f"{shared} see the children first and then text {i}.", False) for i in range(40)]
    rows += [(4000, f"{shared} see the chil", True), (4001, f"{shared} see the children first and", True), (4002, f"{shared} see the", True), (3999, f"{shared} see the\n\nNext it goes on here.", False)]
    whole = f"{opening} {' '.join(f'e{j}w' for j in range(30))} is over there"
    return [*rows, (5000, f"{whole}\n\nAnother line that goes on.", False), (5001, whole, True)]


@pytest.mark.parametrize("settings", [{}, {"many": 0, "first": 1}, {"many": 10, "first": 2, "sample": 10, "known": 3, "extra": 1}])
def test_lookup_by_endings_is_as_exact_as_all_pairs(spark, settings):
    rows = unlike_texts_with_one_ending()
    expected = {}
    for rep, text, asks in rows:
        shown = {aligned_cut(text, other) for _, other, _ in rows if asks and len(text) < len(other)} - {""}
        if shown:
            expected[rep] = min(shown)
    got = aligned_by_index(spark.createDataFrame(rows, "rep bigint, text string, asks boolean"), 5, 0.8, **settings)
    assert {r.rep: r["min(aligned)"] for r in got.groupBy("rep").agg(F.min("aligned")).collect()} == expected
    assert len(expected) > 15 and set(expected.values()) == {"cut", "end"} and {4000, 4001, 4002} <= set(expected)


def test_unlike_texts_with_one_ending_are_not_compared(spark, monkeypatch):
    def counting(size, threshold):
        def run(batches):
            group, waiting = None, 0
            for batch in batches:
                pairs = []
                for key, rep, whole in zip(*(batch.column(c).to_pylist() for c in ("grp", "rep", "is_whole"))):
                    group, waiting = key, (waiting if key == group else 0) + (not whole)
                    pairs += [rep] * (waiting if whole else 0)
                yield type(batch).from_pydict({"rep": pairs, "aligned": [""] * len(pairs)}, schema=schema)

        return run

    schema = pa.schema([("rep", pa.int64()), ("aligned", pa.string())])
    monkeypatch.setattr(truncation, "_seek", counting)
    rows = [r for r in unlike_texts_with_one_ending() if r[0] < 3000]
    compared = aligned_by_index(spark.createDataFrame(rows, "rep bigint, text string, asks boolean"), 5, 0.8).count()
    # 150 texts that ask and 150 others: they were all compared with each other
    assert 15 < compared < 500
