"""Encoding, packing, statistics, repeated lines, spam and scan noise."""

import base64
import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import bpe, packing, quality, repeated_lines, scan_noise, spam

COMMON = frozenset("the a of and is in to it that this der die das und le la et".split())
PROSE = (
    "The old woman went to the river in the morning, and it was cold. She said that the bridge is not safe, "
    "but the children of the village had to cross it. In the end they all came to the other side of the water."
)


@pytest.fixture(scope="module")
def coder():
    path = bpe.vocabulary_path()
    if not Path(path).exists():
        pytest.skip("no vocabulary here")
    return bpe.coder(path)


@pytest.fixture(scope="module")
def encoding(coder):
    tiktoken = pytest.importorskip("tiktoken")
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=coder.ranks, special_tokens={})


def test_ids_equal_a_reference(spark, data, coder, encoding):
    rows = bpe.encode_column(spark.read.parquet(f"{data}/documents.parquet"), "doc_id")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r.doc_id: r.ids for r in rows.collect()}
    assert got == {k: encoding.encode_ordinary(t) if t else [] for k, t in texts.items()}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(coder, encoding, text):
    text = text.encode("utf-8", "ignore").decode()
    assert coder.encode(text) == encoding.encode_ordinary(text)


def test_long_and_special_texts(coder, encoding):
    for text in ("a" * 20_000, "ab" * 3_000 + "!?" * 2_000, "<|endoftext|>", " \n\t ", "\x1c\x1d a\x85 b", "٣٤²Ⅳ", "don't 'S"):
        assert coder.encode(text) == encoding.encode_ordinary(text)
        assert coder.count(text) == len(coder.encode(text))
    assert coder.encode(None) == [] and coder.encode("") == []


def test_round_trip(coder):
    pieces = {i: b for b, i in coder.ranks.items()}
    text = "Größe, naïve — 夢の門 👍🏽 x"
    assert b"".join(pieces[i] for i in coder.encode(text)).decode() == text
    assert base64.b64encode(pieces[0])


def test_encoding_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6), (1, None, 7, 8), (None, "", 1, 1)], "doc_id long, text string, k int, v int")
    assert sorted(len(r.ids) for r in bpe.encode_column(df, "doc_id").collect()) == [0, 0, 2]
    counted = bpe.count_tokens(df).orderBy("k").collect()
    assert [(r.k, r.v, r.n_tokens) for r in counted] == [(1, 1, 0), (5, 6, 2), (7, 8, 0)]
    assert bpe.encode_column(df.limit(0), "doc_id").count() == 0


def test_executors_need_no_vocabulary_file(spark, coder, tmp_path):
    """The file is read by the driver only: it may be gone when tasks run."""
    given = Path(bpe.vocabulary_path()).read_bytes()
    own = tmp_path / "own.tiktoken"
    own.write_bytes(given)
    rows = bpe.encode_column(spark.createDataFrame([(1, "the river")], "doc_id long, text string"), "doc_id", vocabulary=str(own))
    own.unlink()
    assert rows.first().ids == coder.encode("the river")


def packed(spark, items, **options):
    df = spark.createDataFrame(items, "doc_id long, n_tokens int, source string, cluster string")
    rows = packing.pack(df, **options).collect()
    used, copies = defaultdict(list), defaultdict(Counter)
    size = {i[0]: i[1] for i in items}
    cluster = {i[0]: i[3] for i in items}
    for r in rows:
        used[r.sequence_id].append((r.start_token, r.n_tokens))
        if cluster[r.doc_id] and r.n_tokens and size[r.doc_id] <= options.get("capacity", 2048):
            copies[r.sequence_id][cluster[r.doc_id]] += 1
    for spans in used.values():
        spans.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(spans, spans[1:]))
        assert spans[-1][0] + spans[-1][1] <= options.get("capacity", 2048)
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.n_tokens
    assert all(got[k] == max(0, n or 0) for k, n in size.items()) and set(got) == set(size)
    if options.get("cluster_rule") == "strict":
        assert not copies or max(max(c.values()) for c in copies.values()) == 1
    return rows, used, sum(n - 1 for c in copies.values() for n in c.values())


def test_packing_fills(spark):
    rng = random.Random(1)
    items = [(i, min(9_000, int(rng.expovariate(1 / 300))), f"s{min(i % 7, 3)}", f"c{i % 900}") for i in range(1_200)]
    for shard in (10_000, 200):
        rows, used, met = packed(spark, items, shard_items=shard)
        assert met < 12
        total = sum(i[1] for i in items)
        assert len(used) <= total / 2048 * 1.02 + 2
        pieces = Counter(r.doc_id for r in rows)
        assert all((pieces[i[0]] > 1) == (i[1] > 2048) for i in items)


def test_packing_odd_items(spark):
    items = [(1, None, None, None), (2, 0, "a", "x"), (3, -4, "a", "x"), (4, 2048, "a", "y"), (5, 2049, "a", "y"), (6, 5, "a", "z"), (7, 5, "a", "z")]
    packed(spark, items)
    pair = [(1, 5, "a", "z"), (2, 5, "a", "z")]
    assert len(packed(spark, pair, cluster_rule="strict")[1]) == 2
    assert len(packed(spark, pair)[1]) == 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens int, source string, cluster string")).count() == 0


def test_packing_hot_copies(spark):
    """A third of the rows are one text: space goes before parting them, and the rounds end."""
    items = [(i, 100 if i % 3 == 0 else 90 + i % 50, f"s{i % 5}", "same" if i % 3 == 0 else f"c{i}") for i in range(900)]
    total = sum(i[1] for i in items)
    assert len(packed(spark, items, shard_items=400)[1]) <= total / 2048 * 1.05 + 1
    assert len(packed(spark, items, shard_items=400, cluster_rule="strict")[1]) >= 300


def test_source_rule():
    strict, prefer = packing.Shard(10, 0, "strict"), packing.Shard(10, 0, "prefer")
    assert [strict.place(3, 1, 0)[0] for _ in range(2)] == [0, 1]
    assert [prefer.place(3, 1, 0)[0] for _ in range(2)] == [0, 0]
    shard = packing.Shard(10)
    for size, source in ((7, 1), (6, 2)):
        shard.place(size, source, 0)
    # the tightest sequence has the item's source: the next larger space is taken
    assert shard.place(3, 1, 0)[0] == 1


def test_statistics(spark):
    table = "\n".join(f"{i * 37}\tsymbol\t{i * 91}\tbrother" for i in range(1, 15))
    index = "\n".join(f"river, {i}, {i + 40}–{i + 44}, {i + 90}" for i in range(12))
    df = spark.createDataFrame(
        [("a", PROSE, 5), ("b", table, None), ("c", index, 0), ("d", None, 3), ("e", " \n ", None), ("f", PROSE.upper(), 1), ("b", table, None), ("g", "", 1)],
        "id string, text string, char_count int",
    )
    stats = quality.text_statistics(df, COMMON)
    assert {r.id for r in quality.not_prose(stats).collect()} == {"b", "c"}
    rows = {r.id: r for r in stats.collect()}
    assert rows["a"].char_count_gap == len(PROSE) - 5 and rows["b"].char_count_gap is None
    assert rows["d"].word_count == 0 and rows["e"].char_len == 3 and not rows["e"].is_prose
    assert rows["b"].delimiter_alignment == 1.0 and rows["a"].is_prose
    assert quality.text_statistics(df.limit(0), COMMON).count() == 0
    once = quality.text_statistics(df, COMMON, once=True).collect()
    assert len(once) == len({r.id for r in once}) == len(rows) and all(rows[r.id] == r for r in once)
    assert quality.text_statistics(df.limit(0), COMMON, once=True).count() == 0


LISTS = {
    "bullets": "\n".join(f"• {a} {b}" for a in ("quiet", "golden", "broken") for b in ("river", "wolf", "tower")),
    "inline": "; ".join(f"◦ {a} {b}" for a in ("quiet", "golden", "broken") for b in ("river", "wolf", "tower")),
    "index": " ".join(f"{w}, {n}, {n + 4}–{n + 9}" for n, w in enumerate("river wolf tower bridge garden".split(), 30)),
    "contents": "\n".join(f"{n}. {w} ........ {n * 7}" for n, w in enumerate("River Wolf Tower Bridge Garden".split(), 1)),
    "columns": "\n".join(f"{w}   {n * 3}.5   {n * 7}.25" for n, w in enumerate("river wolf tower bridge garden".split(), 10)),
    "two rows": "river, broad, 71, 301, 495\nwolf, young, 32, 136, 363",
    "open rows": "ambiguous mountains\ndead forest lantern\nfertile passage\nwide child garden\ncultural figure\nlong summer",
}


@pytest.mark.parametrize("name", sorted(LISTS))
def test_layout_tells_lists(name, monkeypatch):
    assert quality.nonprose_share(LISTS[name], COMMON) > 0.5
    monkeypatch.setattr(quality, "WEIGHTS", (0.0, 0.0, 0.0, 0.0, *quality.WEIGHTS[4:]))
    assert quality.nonprose_share(LISTS[name], COMMON) == 0.0


def test_letters_tell_junk():
    for text in ("m~co dim(( _ k.£ |li1c )k_buu a:,(( *r/\\ a £dmI_* £^m1x ~l»k e l*§§u::", "zvkqx wgjpb xqzvk mfwpb gkxzv qjvbw pkzgf xvqwj bzkpg wvxqj"):
        assert quality.nonprose_share(text, COMMON) == 1.0
    for text in ("THE QUIET RIVER", "Vienna, 1931", "no ancient brother obscures", "a", "1931", PROSE.upper(), PROSE.replace(", ", ",\n")):
        assert quality.nonprose_share(text, COMMON) == 0.0


def test_layout_decides_on_the_tables(spark, data, monkeypatch):
    """Without the layout at least a fifth of the found chunks are not found."""
    common = quality.common_words(spark.read.parquet(f"{data}/common_words.parquet"))
    texts = [r.text for r in spark.read.parquet(f"{data}/chunks.parquet").select("text").collect() if r.text and r.text.strip()]
    found = [t for t in texts if quality.nonprose_share(t, common) > 0.5]
    monkeypatch.setattr(quality, "WEIGHTS", (0.0, 0.0, 0.0, 0.0, *quality.WEIGHTS[4:]))
    assert 0 < len([t for t in found if quality.nonprose_share(t, common) > 0.5]) <= 0.8 * len(found)


def test_weights_are_fitted(spark):
    blocks = [(t, True) for t in LISTS.values()] + [(PROSE, False), (PROSE.replace(", ", ",\n"), False), ("The river", False), (None, True), ("x", None), (" ", True)]
    df = spark.createDataFrame(blocks, "block string, nonprose boolean")
    weights = quality.fit_weights(df, COMMON, rounds=500)
    assert weights[0] > 1 and weights[-1] < 0
    assert weights == quality.fit_weights(df.repartition(3), COMMON, rounds=500)
    with pytest.raises(ValueError):
        quality.fit_weights(df.where("nonprose"), COMMON)


def brute_lines(rows, least):
    count, places = defaultdict(set), set()
    for i, text, source in rows:
        for n, line in enumerate(text.split("\n") if text else []):
            key = (source, re.sub("[0-9]+", "0", re.sub("[ \t\r\xa0]+", " ", line.lower())).strip())
            if sum(c.isalpha() for c in line) >= 25:
                count[key].add(i)
                places.add((i, n, key))
    return {(i, n) for i, n, key in places if len(count[key]) >= least}


@pytest.mark.parametrize("parts", [1, 2, 3])
def test_repeated_lines_by_deltas(spark, parts):
    rng = random.Random(parts)
    notices = [f"Property of the library number {{}} on the hill, do not remove {w}" for w in ("ever", "please", "now")]
    rows = []
    for i in range(120):
        lines = [rng.choice(notices).format(rng.randint(1, 99)).replace(" ", rng.choice([" ", "  ", "\xa0"])), f"A line of its own, which has the number {i} {'x' * i}"]
        rng.shuffle(lines)
        rows.append((f"id{i}", "\n".join(lines), rng.choice(["a", "a", "b", None])))
    rows += rows[:10] + [("n", None, "a"), ("e", "", "a")]
    df = spark.createDataFrame([(*r, k * parts // len(rows)) for k, r in enumerate(rows)], "id string, text string, source_file string, part int")
    cut = [df.where(F.col("part") == p).drop("part") for p in range(parts)]
    found = repeated_lines.repeated_lines(cut[0], cut[1:])
    assert {(r.id, r.line_no) for r in found.collect()} == brute_lines(rows, 8)
    rebuilt = repeated_lines.without_lines(df, found).collect()
    assert len(rebuilt) == len({r.id for r in rebuilt}) and all("Property" not in r.text for r in rebuilt)


def test_counts_are_kept_from_run_to_run(spark, tmp_path):
    """Two runs in sessions of their own: the second merges into the table of the first and rebuilds only what it concerns."""
    notice, other = "Property of the library on the hill, do not remove", "Printed for the friends of the river and the bridge"
    first = [(f"a{i}", f"Text {i}\n{notice} {i}", "s") for i in range(7)] + [(f"o{i}", f"{other}\nText {i}", "s") for i in range(9)]
    later = [("b0", f"{notice} 77\nmore", "s"), ("b1", "a text of its own that has no line of others", "s"), ("a0", f"Text 0\n{notice} 0", "s")]
    frame = lambda session, rows: session.createDataFrame(rows, "id string, text string, source_file string")
    path = str(tmp_path / "counts")
    one, two, three = spark.newSession(), spark.newSession(), spark.newSession()
    added = repeated_lines.LineCounts(one, path).merge(frame(one, first))
    assert {r.id for r in added.collect()} == {f"o{i}" for i in range(9)}
    table = repeated_lines.LineCounts(two, path)
    assert table.merges() == 1 and table.places().count() == 9
    added = table.merge(frame(two, later))
    # the line crossed by this merge: texts of before are concerned, those of the line crossed before are not
    assert {r.id for r in added.collect()} == {f"a{i}" for i in range(7)} | {"b0"}
    rebuilt = {r.id: r.text for r in repeated_lines.rebuilt_texts(frame(two, first + later), table, added).collect()}
    assert rebuilt == {f"a{i}": f"Text {i}" for i in range(7)} | {"b0": "more"}
    # a merge that was cut off before it was complete is done again
    again = repeated_lines.LineCounts(three, path)
    (tmp_path / "counts" / "counts" / "_3").mkdir()
    again.merge(frame(three, [("c", f"{other}\nx", "s")]))
    assert again.merges() == 3 and {(r.id, r.line_no) for r in again.places().collect()} == brute_lines(first + later + [("c", f"{other}\nx", "s")], 8)


def test_repeated_lines_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, text string, source_file string")
    assert repeated_lines.repeated_lines(empty, [empty]).count() == 0


def brute_repeats(symbols, least):
    n = len(symbols)
    covered = [False] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and symbols[i + k] == symbols[j + k]:
                    k += 1
                if k >= least:
                    covered[i : i + k] = [True] * k
    return covered


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.integers(2, 5))
def test_suffix_automaton(symbols, least):
    expected = brute_repeats(symbols, least)
    assert spam.repeated(symbols, least).tolist() == expected
    if len(symbols) > least:
        # long pages give the same by arrays
        assert spam.repeated_long(symbols, least).tolist() == expected


def test_the_automaton_decides_on_the_tables(spark, data, monkeypatch):
    """Without coverage at least a fifth of the found pages are not found; and no page is passed over that coverage would find."""
    common = quality.common_words(spark.read.parquet(f"{data}/common_words.parquet"))
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    found = [t for t in texts if spam.spam_share(t, common, 0.5) > 0.5]
    assert found == [t for t in texts if spam.spam_share(t, common) > 0.5] and found
    monkeypatch.setattr(spam, "repeated", lambda symbols, least=3: np.zeros(len(symbols), dtype=bool))
    assert len([t for t in found if spam.spam_share(t, common) > 0.5]) <= 0.8 * len(found)


def test_spam(spark):
    keywords = "golden river buy, golden river cheap, silver bridge online, golden river free, silver bridge buy\n" * 4
    links = "\n".join(f"https://shop.a{i}b.example/x/{i}" for i in range(8))
    tags = "#river #bridge #river #wolf #river #bridge\n" * 3
    contents = "\n".join(f"{i}. The River and the Bridge ........ {i * 7}" for i in range(1, 12))
    rows = [(1, PROSE), (2, keywords), (3, links), (4, tags), (5, contents), (6, None), (7, ""), (8, "in one"), (9, PROSE + "\n#river #bridge"), (2, keywords), (10, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in spam.spam_pages(df, COMMON).collect()) == [2, 3, 4]
    assert spam.spam_pages(df.limit(0), COMMON).count() == 0


def scanned(vocabulary, text, **fields):
    titles = scan_noise.titles_of(fields.get("file"), fields.get("title"), fields.get("chapter"))
    model = scan_noise.first_model()
    return scan_noise.noises(text, titles, vocabulary, model), scan_noise.repaired(text, titles, vocabulary, model)


def test_scan_noise():
    words = frozenset(re.findall(r"\w+", PROSE.lower())) | {"pilgrim", "tree"}
    v = scan_noise.Vocabulary(words)
    clean = "The old woman went to the river\nin the morning, and it was cold."
    assert scanned(v, clean) == (set(), clean.replace("\n", " "))
    assert scanned(v, "The pil-\ngrim went to the bri¬ \ndge.") == ({"hyphen"}, "The pilgrim went to the bridge.")
    assert scanned(v, "Tlie 0ld w~oman wcnt to the rivcr.") == ({"misread"}, "The old woman went to the river.")
    page = "The old woman went to the\n~ 12 ~\nriver in the morning.\n"
    assert scanned(v, page) == ({"page_number"}, "The old woman went to the river in the morning.")
    head = "The old woman went to the\n\n[ The Silent River ]\n\nlviii\n\nriver in the morning."
    assert scanned(v, head) == ({"header", "page_number"}, "The old woman went to the river in the morning.")
    beside = "The old woman went to the\nTHE SILENT RIVER    77\nriver in the morning."
    assert scanned(v, beside)[0] == {"header", "page_number"}
    opens = "CHAPTER IV: The Silent River\n\n§ 12.\n\n1931\n\nThe old woman went to the river."
    assert scanned(v, opens, chapter="Chapter IV: The Silent River")[0] == set()


def test_viterbi_is_the_best_path():
    rng = random.Random(3)
    model = scan_noise.first_model()
    n = len(scan_noise.BASE)
    for _ in range(10):
        seen = [rng.randrange(scan_noise.OBSERVATIONS) for _ in range(4)]

        def value(path):
            moves = sum(model.moves[a, b] for a, b in zip(path, path[1:]))
            return model.start[path[0]] + moves + sum(model.looks[k, o] for k, o in zip(path, seen))

        best = max(((a, b, c, d) for a in range(n) for b in range(n) for c in range(n) for d in range(n)), key=value)
        assert scan_noise.label(seen, model) == [scan_noise.BASE[k] for k in best]
    assert scan_noise.label([], model) == []


def test_the_model_is_fitted():
    """Likelihood does not fall by a round, and lines around a look decide what it is after a fit as before."""

    def likelihood(model, texts):
        total = 0.0
        for seen in texts:
            f = model.start + model.looks[:, seen[0]]
            for o in seen[1:]:
                f = np.logaddexp.reduce(f[:, None] + model.moves, axis=0) + model.looks[:, o]
            total += np.logaddexp.reduce(f)
        return total

    page = "the old woman went to the\nriver in the morning and\n\n{}\n\nto the other side of the\nwater. It was cold.\n\nShe was there."
    seen = lambda text: scan_noise.observed(lines := text.split("\n"), scan_noise.looks_of(lines, frozenset())[0])
    texts = [seen(page.format(x)) for x in ("~ 12 ~", "77", "[ The River ]", "THE RIVER   12")] * 40
    first = scan_noise.first_model()
    fitted = [scan_noise.fit_model(texts, rounds, prior=1.0) for rounds in (1, 2, 4)]
    values = [likelihood(m, texts) for m in (first, *fitted)]
    assert values[0] < values[1] <= values[2] + 1e-6 <= values[3] + 2e-6
    for m in (first, fitted[-1], scan_noise.fit_model(texts)):
        assert [scan_noise.label(t, m)[3] for t in texts[:4]] == [scan_noise.NUMBER, scan_noise.NUMBER, scan_noise.HEADER, scan_noise.HEADER]
    assert np.array_equal(scan_noise.fit_model([]).moves, first.moves)
    # the same year is a page's number amid a sentence and a date between paragraphs
    amid = "the old woman went to the\n1931\nriver in the morning and went."
    between = "The old woman went home.\n\n1931\n\nShe was there in the morning."
    for text, expected in ((amid, scan_noise.NUMBER), (between, scan_noise.HEADING)):
        assert expected in scan_noise.labelled(text, frozenset(), first)[1]


def test_lines_decide_on_the_tables(spark, data):
    """Without the labels of lines at least a fifth of the rows are not found."""
    common = quality.common_words(spark.read.parquet(f"{data}/common_words.parquet"))
    kinds = Counter(r.noise for r in scan_noise.find_noise(spark.read.parquet(f"{data}/chunks.parquet"), common).collect())
    assert kinds["header"] + kinds["page_number"] >= 0.2 * kinds.total() and min(kinds.values()) > 0 and len(kinds) == 4


def test_a_vocabulary_beyond_the_broadcast_gives_the_same(spark, data):
    common = quality.common_words(spark.read.parquet(f"{data}/common_words.parquet"))
    chunks = spark.read.parquet(f"{data}/chunks.parquet")
    for most in (0, 50):
        found = [sorted(map(tuple, scan_noise.find_noise(chunks, common, **o).collect())) for o in ({}, {"most_words": most})]
        assert found[0] == found[1] and any(n == "misread" for _, n in found[0])
        fixed = [sorted(map(tuple, scan_noise.repair(chunks, common, **o).collect()), key=str) for o in ({}, {"most_words": most})]
        assert fixed[0] == fixed[1]


def test_repair_once(spark):
    df = spark.createDataFrame([("a", PROSE.replace("river", "riv-\ner")), ("a", PROSE.replace("river", "riv-\ner")), ("b", None), ("b", None), ("c", "")], "id string, text string")
    assert sorted(map(tuple, scan_noise.repair(df, COMMON, once=True).collect())) == [("a", PROSE), ("b", None), ("c", "")]
    assert scan_noise.repair(df, COMMON).count() == 5


def test_find_noise(spark):
    clean = [(f"c{i}", PROSE, "(A 1) Stone, C. - The Silent River - P (1950).txt") for i in range(5)]
    rows = clean + [("n", PROSE.replace("river", "riv-\ner").replace("the ", "tlie ", 1), None), ("n", PROSE.replace("river", "riv-\ner").replace("the ", "tlie ", 1), None), ("x", None, None), ("y", "", None)]
    df = spark.createDataFrame(rows, "id string, text string, source_file string")
    assert sorted((r.id, r.noise) for r in scan_noise.find_noise(df, COMMON).collect()) == [("n", "hyphen"), ("n", "misread")]
    repaired = {r.id: r.text for r in scan_noise.repair(df, COMMON).collect()}
    assert repaired["n"] == PROSE and repaired["x"] is None and repaired["y"] == ""


def test_frequent_misread_forms_are_no_words(spark):
    said = PROSE.replace("the children", "their children")
    rows = [(f"c{i}", said) for i in range(160)] + [(f"m{i}", said.replace("their", "tlieir")) for i in range(3)]
    df = spark.createDataFrame(rows, "id string, text string")
    assert sorted((r.id, r.noise) for r in scan_noise.find_noise(df, COMMON).collect()) == [(f"m{i}", "misread") for i in range(3)]
    # a rare word as much at home in clean texts as the frequent one is a word
    words = spark.createDataFrame(
        [("day", 5000, 4000), ("clay", 40, 31), ("their", 5000, 4000), ("tlieir", 40, 12), ("theſe", 9, 9), ("these", 900, 700), ("thcir", 101, 30)],
        "word string, n long, clean long",
    )
    assert sorted(r.word for r in scan_noise.misread_forms(words).collect()) == ["theſe", "tlieir"]


def test_heads_between_empty_lines_are_seen():
    v = scan_noise.Vocabulary(frozenset(re.findall(r"\w+", PROSE.lower())))

    def found(block, **fields):
        titles = scan_noise.titles_of(None, fields.get("title"), None)
        text = scan_noise.prose_text(f"{PROSE}\n\n{block}\n\n{PROSE}", COMMON, titles)
        return scan_noise.noises(text, titles, v, scan_noise.first_model())

    assert found("L E T T E R S     T O     M O M O X ,     V O L .     1") == {"header"}
    assert found("L E T T E R S     T O     M O M O X ,     V O L .     1\n[PAGE 99]") == {"header", "page_number"}
    assert found("L E T T E R S     T O     M O M O X ,     V O L .     1     77") == {"header", "page_number"}
    assert found("[ Silent Rivers Flowing Deep ]") == {"header"}
    assert found("SILENT RIVERS FLOWING DEEP", title="Silent Rivers Flowing Deep") == {"header"}
    # lists and junk are still left out
    assert found("qxv~zk wqj^rt plm#fgh zzk%tt yvv") == set()
    assert found("Stone, silent    12\nRiver, deep    14") == set()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_repair_leaves_lists_and_tables_in_place(spark, end):
    table = end.join(["   wclf\t1901\tx^y/12   ab-", "  rivcr\t1902\tz^q/13   cd", "  stone\t1903\tw^k/14   ef"])
    wrapped = PROSE.replace(". ", "." + end).replace("river", "riv-" + end + "er", 1)
    rows = [(f"c{i}", PROSE) for i in range(5)] + [
        ("amid", end.join([wrapped, "", table, " ", wrapped])),
        ("first", end.join([table, "", wrapped])),
        ("last", end.join([wrapped, "", table])),
        ("twice", end.join([wrapped, "", table, "", "", table, "", wrapped])),
        ("page", end.join([wrapped, "", "~ 12 ~", "", table, "", "and so " + wrapped])),
    ]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.id: r.text for r in scan_noise.repair(df, COMMON).collect()}
    assert got["amid"] == "\n\n".join([PROSE, table, PROSE])
    assert got["first"] == "\n\n".join([table, PROSE])
    assert got["last"] == "\n\n".join([PROSE, table])
    assert got["twice"] == "\n\n".join([PROSE, table, table, PROSE])
    assert got["page"] == "\n\n".join([PROSE, table, "and so " + PROSE])


def test_heads_in_sentence_case():
    v = scan_noise.Vocabulary(frozenset(re.findall(r"\w+", (PROSE + " the growth of inner images l'ombre et les images du fleuve").lower())))

    def seen(head, **fields):
        return scanned(v, f"The old woman went to the\n{head}\nriver in the morning.", **fields)

    assert seen("The growth of inner images", chapter="Chapter 2: The growth of inner images") == ({"header"}, "The old woman went to the river in the morning.")
    assert seen("“L'ombre et les images du fleuve”", title="L'ombre et les images du fleuve")[0] == {"header"}
    assert seen("The growth of inner images", title="The growth of inner images and more")[0] == set()
    assert seen("The growth of inner images is", title="The growth of inner images")[0] == set()


def test_short_spam():
    for page in ("#river #wolf #bridge", "river | wolf | bridge", "https://wolves.example/river", "wolf wolf wolf wolf", "Wolf » River » Tags"):
        assert spam.spam_share(page, COMMON) > 0.5, page
    for page in ("suddenly", "Vienna, 12/3/31", "no ancient brother obscures", "Letter #12", "* * *", "he and/or it", "• later", "#", "|", "\x00"):
        assert spam.spam_share(page, COMMON) == 0.0, page
