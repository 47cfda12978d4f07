"""The text operators against brute force, exact round trips and held-out accuracy."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orientlake.llm import bloom, components, decontaminate, language, lattice_lm, mixing, ngram_join, surrogates, tokens, toxicity, url_filter, vector_forest
from orientlake.llm.common import Scratch
from orientlake.llm.queries import QUERIES, table
from orientlake.session import new_dir

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text", "source", "lang").collect()]


def reach(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def grams(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def alike(texts, percent=80):
    sets = {k: grams(t) for k, t in texts}
    holds = defaultdict(set)
    for k, s in sets.items():
        for g in s:
            holds[g].add(k)
    pairs = {p for ks in holds.values() for p in itertools.combinations(sorted(ks), 2)}
    return sets, [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000) for i in range(1, 200)] + [(5, 5), (None, 3)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(4)).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def test_ngram_join_links_are_those_of_brute_force(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(3, 90))] for _ in range(30)]
    texts = []
    for i in range(300):  # near copies around the threshold, one group far larger than the others, shared passages
        w = list(base[0 if i % 3 == 0 else rnd.randrange(30)])
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        if rnd.random() < 0.2:
            w += base[1][:20]
        texts.append((i, " ".join(w).title() if i % 5 == 0 else "  ".join(w)))
    sets, links = alike(texts)
    want = reach([k for k, _ in texts], links)
    got = {r["file"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_texts(spark.createDataFrame(texts, "file bigint, value string").repartition(5)).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k, _ in texts}


def test_rare_first_prefix_keeps_a_shared_gram():
    rarity = np.zeros(1 << ngram_join.SKETCH_BITS, np.int64)

    class Sent:
        value = rarity
    a, b = " ".join(f"x{i}" for i in range(104)), " ".join([f"x{i}" for i in range(94)] + [f"y{i}" for i in range(10)])
    out = list(ngram_join._prefixes(5, 80, Sent)(iter([{"_key": [1, 2], "_text": [a, b]}])))[0]
    assert [list(out["key"]).count(k) for k in (1, 2)] == [21, 21]
    first, second = (set(out["gram"][out["key"] == k]) for k in (1, 2))
    assert first & second


def shares(sizes, weights=(5, 2, 1), cap=3):
    """Targets by sharing the excess again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total >= cap * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = float(cap * sizes[s])
            open_.remove(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


def test_mix_meets_targets_and_repeats(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", "dd", None]), int(rnd.paretovariate(1.1) * 20)) for i in range(3000)] + [(9000, "z", 0)]
    df = spark.createDataFrame(rows, "micrograph bigint, optics_group string, n_particles bigint")
    got = mixing.mix_sources(df).collect()
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    want = shares(sizes)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["copies"] <= 3 and abs(r["target"] - want[r["optics_group"]]) <= 1e-6 * max(1, want[r["optics_group"]])
        taken[r["optics_group"]] += r["copies"] * r["n_particles"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.001 * t, 25), s
    # rates are the exponential tilt: log rate grows in proportion to size, up to the cap
    for s in {"a", "b", "c"}:
        free = [(r["n_particles"], math.log(r["rate"])) for r in got if r["optics_group"] == s and r["n_particles"] and r["rate"] < 3 * (1 - 1e-9)]
        slopes = [v / n for n, v in free]
        assert max(slopes) - min(slopes) <= 1e-9 + 1e-6 * max(map(abs, slopes))
    again = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_token_files_round_trip(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = [(100001, "<|endoftext|> don't we'll x é é ́a 12,5 日本語 " + "q" * 300), (100002, "a" * 5000 + " b"), (100003, "x\n\ny\t z\r\n"), (100004, ""),
           (100005, "ΟΔΟΣ word., a.b 3.5,x U.S.A. it's. 'S ÀÉ.,ß. İstanbul"), (100006, "end.\u0301 e\u0301. x,\u0301")]
    texts = [(d, t) for d, t, *_ in docs] + odd
    folder = new_dir(spark, "test-tokens")
    listed = tokens.write_tokens(spark.createDataFrame(texts, "pid bigint, value string"), folder, path).collect()
    encoder, start = Tokenizer.from_file(path), 0
    got = {r["pid"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read_tokens(spark, folder).collect()}
    for d, t in sorted(texts):
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [2]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sum(r["n_tokens"] for r in listed) == start
    ids, offsets, keys = tokens.open_shard(folder, listed[0]["name"])
    assert isinstance(ids, np.memmap) and ids.dtype == np.uint16 and offsets[-1] == len(ids) == listed[0]["n_tokens"] and len(keys) == listed[0]["n_docs"]


def test_cascade_is_exact_on_its_universe(spark):
    scratch = Scratch(spark)
    universe = spark.range(4000).select(F.concat(F.lit("mic_"), F.col("id").cast("string")).alias("key"))
    listed = universe.where("xxhash64(key) % 7 = 0")
    cascade = url_filter.Cascade(universe, listed, scratch, rate=0.3)
    assert len(cascade.levels) >= 3
    told = universe.withColumns(cascade.columns()).select("key", cascade.contains(F.col("key")).alias("inside"))
    assert {r["key"] for r in told.where("inside").collect()} == {r["key"] for r in listed.collect()}


def test_url_filter_has_no_python_and_no_join(spark, capsys):
    pages = table(spark, SF, "pages")
    url = url_filter.judge_urls(pages, [("block", "net/")])
    assert url.count() == pages.count()


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "ba", "aba"] + [f"\x00{b:02X}" for b in range(256)]
    rnd = random.Random(5)
    weights = {p: rnd.random() for p in pieces}
    total = sum(weights.values())
    score = {p: math.log(w / total) for p, w in weights.items()}
    lattice = lattice_lm.Lattice(score | {lattice_lm.END: -1.0})

    def all_ways(text):
        if not text:
            return 1.0
        out = 0.0
        for i in range(1, len(text) + 1):
            if text[:i] in score:
                out += math.exp(score[text[:i]]) * all_ways(text[i:])
        if text[0] not in score:
            out += math.prod(math.exp(score[f"\x00{b:02X}"]) for b in text[0].encode()) * all_ways(text[1:])
        return out

    for word in ("ab", "abab", "aabbaba", "aéb", "x"):
        assert math.isclose(lattice.word(word), math.log(all_ways("▁" + word)), rel_tol=1e-9)
        into = Counter()
        lattice.expected(word, 1.0, into)
        spelled = sum(n * (1 if p[0] == "\x00" else len(p)) for p, n in into.items())
        assert math.isclose(spelled, 1 + sum(1 if c in score else len(c.encode()) for c in word), rel_tol=1e-9)


def test_lattice_base_scores(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op4_lattice_score"](spark, SF).collect()}
    words = {d: (t or "").encode().lower().split() for d, t, *_ in docs}
    train = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    ends = sum(zlib.crc32(str(d).encode()) % 7 != 2 for d in words)
    n, v = sum(train.values()) + ends, len(train) + 1
    for d, ws in words.items():
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        assert (got[d]["n_tokens"], got[d]["n_known"], got[d]["train_tokens"]) == (len(ws) + 1, sum(train[w] > 0 for w in ws) + 1, n)
        assert math.isclose(got[d]["base_score"], base, rel_tol=1e-9) and got[d]["score"] < 0
    held = [got[d]["score"] / got[d]["n_tokens"] for d in words if got[d]["held_out"]]
    own = [got[d]["score"] / got[d]["n_tokens"] for d in words if not got[d]["held_out"]]
    assert abs(np.mean(held) - np.mean(own)) < 1


def test_non_negative_risk_separates():
    rnd = np.random.default_rng(1)
    positive = [np.array([0, *(3 + rnd.integers(0, 50, 5))]) for _ in range(200)]
    unlabelled = [np.array(([0] if i % 5 == 0 else [1]) + list(3 + rnd.integers(0, 50, 5))) for i in range(1000)]
    w, b = toxicity.fit_non_negative(positive, unlabelled, 53, 0.2)
    score = [1 / (1 + math.exp(-(b + w[u].sum()))) for u in unlabelled]
    assert sum((s >= 0.3) == (i % 5 == 0) for i, s in enumerate(score)) >= 990


def test_toxicity_held_out(spark):
    got = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.01").collect()}
    marks = {r["doc_id"]: r["toxic"] for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    held = [(got[d]["predicted"], t) for d, t in marks.items() if got[d]["held_out"]]
    assert sum(p == t for p, t in held) >= 0.9 * len(held)
    assert sum(p for p, t in held if t == 0) <= 0.03 * sum(t == 0 for _, t in held)


def test_toxicity_reads_words_of_any_length(spark):
    own = sorted({g for g in toxicity.text_grams("hateword").tolist()} - set(toxicity.text_grams("-").tolist()))
    model = toxicity.ToxicityModel(np.array(own), np.full(len(own), 2.0), -5.0, 0.1)
    rows = [(1, "a" * 300 + ".hateword-x"), (2, "x_" * 40_000 + "hateword"), (3, "a" * 300 + ".other-words"), (4, "hateword")]
    texts = spark.createDataFrame(rows, "doc_id int, text string")
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score_toxicity(texts, model).collect()} == {1: 1, 2: 1, 3: 0, 4: 1}
    assert [r["doc_id"] for r in toxicity.without_toxic(texts, model).collect()] == [3]
    for word in ("ab" * 40_000 + "c", "xy" * 16_380 + "hateword", "abc", "hateword"):
        marked = f"^{word}$"
        runs = {marked[i:i + n] for n in (4, 5, 6) for i in range(len(marked) - n + 1)}
        want = {int(toxicity._keys([r])[0][-1]) for r in runs} | {int(toxicity._whole([marked])[0])}
        assert set(toxicity.text_grams(word).tolist()) == want
        known = np.array(sorted(want), np.int64)
        assert [known[sorted(got)].tolist() for got in toxicity._Grams(known).of([word, "other things", word])] == [known.tolist(), [], known.tolist()]


def test_toxicity_reads_disguised_words():
    assert [toxicity.plain(w) for w in ("L0ser!", "l-o-s-e-r", "Lóóser", "looooser", "2019", "...", "\u0441\u043b\u043e\u0432\u043e")] == ["loser"] * 4 + ["", "", "\u0441\u043b\u043e\u0432\u043e"]
    assert toxicity.words_in("he is a b l o s e r") == {"he", "is", "abloser"} and toxicity.words_in("x y z 1") == {"xyz1"} and toxicity.words_in("a b") == {"a", "b"}


def test_toxicity_of_long_texts_with_a_short_passage_and_of_many_copies(spark):
    """A marked passage counts in a text of any length, and a large group of copies of one toxic text does not crowd out the others."""
    rnd = random.Random(11)
    syllables = ["ba", "ke", "li", "mo", "nu", "ra", "si", "to", "ve", "wy"]
    marks = ["scumbag", "vequita", "lostrano", "grobulex", "chonadri"]

    def words(n):
        return ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(n)]

    def toxic(n):
        w = words(n)
        for _ in range(2):
            w.insert(rnd.randrange(len(w)), rnd.choice(marks) + rnd.choice(syllables))
        return " ".join(w)

    rows, labels = [], []
    copied = toxic(60)
    for i in range(2400):
        kind = "copy" if i % 4 == 0 and i < 1200 else "toxic" if i % 10 == 1 else "clean"
        rows.append((i, copied if kind == "copy" else toxic(rnd.randint(30, 90)) if kind == "toxic" else " ".join(words(rnd.randint(30, 90)))))
        if i % 3 != 2:
            labels.append((i, int(kind != "clean")))
    tests = [(10_000 + i, toxic(rnd.choice([20, 60, 3000]))) for i in range(60)] + [(20_000 + i, " ".join(words(rnd.choice([20, 60, 3000])))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(spark.createDataFrame(tests, "doc_id bigint, text string"), model).collect()}
    assert min(s for k, s in got.items() if k < 20_000) > max(s for k, s in got.items() if k >= 20_000)
    assert sum(s >= 0.3 for k, s in got.items() if k < 20_000) >= 57 and sum(s >= 0.3 for k, s in got.items() if k >= 20_000) == 0


def test_surrogates_keep_form_and_stay_apart(spark):
    people = ["Mr. Peter Smith", "Mrs. Anna Smith", "PETER SMITH", "Herr Peter Smith", "господин Иван Петров", "Maria Lopez"]
    rows = [(i, f"Call {p} at +1 (212) 555-0{i:03d} or p{i}.x@mail{i}.example.com, card 4111 1111 1111 1111, host 10.0.{i}.7!") for i, p in enumerate(people)]
    rows += [(100 + i, f"user{i % 300}@corp.org wrote from 192.168.{i % 200}.{i % 250}") for i in range(600)]
    got = {r["file"]: r for r in surrogates.replace_personal_data(spark.createDataFrame(rows, "file bigint, value string")).collect()}
    old_values = re.compile(r"[\w.]+@[\w.]+|\d+\.\d+\.\d+\.\d+")
    one_to_one = {}
    for i, text in rows:
        new = got[i]["value"]
        before, after = old_values.findall(text), old_values.findall(new)
        assert len(before) == len(after)
        for a, b in zip(before, after):
            assert a != b and one_to_one.setdefault(a, b) == b
    assert len(set(one_to_one.values())) == len(one_to_one) and not set(one_to_one.values()) & set(one_to_one)
    first = got[0]["value"]
    assert re.fullmatch(r"Call Mr\. [A-Z][a-z]+ [A-Z][a-z]+ at \+1 \(\d{3}\) \d{3}-\d{4} or [a-z]\d\.[a-z]@[a-z]{4}\d\.example\.com, card \d{4} \d{4} \d{4} \d{4}, host [\d.]+!", first)
    assert first.split()[2] in surrogates.GIVEN["m", "latin"] and got[1]["value"].split()[2] in surrogates.GIVEN["f", "latin"]
    assert got[3]["value"].split()[2:4] == first.split()[2:4]  # one person, two titles
    assert got[4]["value"].split()[2] in surrogates.GIVEN["m", "cyrillic"]
    assert got[5]["value"].split()[1] in surrogates.GIVEN["f", "latin"]
    digits = [int(c) for c in re.search(r"card ([\d ]+)", first)[1] if c.isdigit()]
    assert sum(d if i % 2 else (2 * d - 9 if 2 * d > 9 else 2 * d) for i, d in enumerate(digits)) % 10 == 0
    assert "PETER SMITH" in got[2]["value"]  # neither a title nor a given name in its usual case


def test_surrogates_never_run_out(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("email", f"{a}@{b}.de") for a in letters for b in letters[:20]] + [("email", "user@example.com"), ("email", "User@Example.com"), ("secret", "######")]
    rows += [("phone", f"+1 {i // 10:02d} {i % 10}0") for i in range(100)] + [("name", "Mr Smith"), ("name", "г-жа Иванова")]
    scratch = Scratch(spark)
    found = spark.createDataFrame(rows, "kind string, value string")
    given = {(r["kind"], r["identity"]): r["surrogate"] for r in surrogates.assign_surrogates(found, "s", scratch).collect()}
    assert len(given) == len(rows) - 1 and len({(k, v) for (k, _), v in given.items()}) == len(given)
    assert not {(k, v) for (k, _), v in given.items()} & set(given)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.de", v) for (k, i), v in given.items() if k == "email" and i.endswith(".de"))
    assert re.fullmatch(r"[a-z]{4}@example\.com", given["email", "user@example.com"]) and given["secret", "######"].startswith("######")
    scratch.clear()
    texts = [(i, f"mail {v.upper()} now") for i, (k, v) in enumerate(rows) if k == "email" and v.endswith(".de")] + [(-1, "to user@example.com, password=###### ok")]
    got = {r["file"]: r["value"] for r in surrogates.replace_personal_data(spark.createDataFrame(texts, "file int, value string"), secret="s").collect()}
    assert all(re.fullmatch(r"mail [a-z]+@[a-z]\.de now", got[i].lower()) for i, _ in texts if i >= 0)
    assert len({v.lower() for v in got.values()}) == len(texts) and re.fullmatch(r"to [a-z]{4}@example\.com, password=######[a-z]+ ok", got[-1])
    for attempt in (0, 4, 9):
        name = spark.createDataFrame([("name", "smith", attempt, "m", "latin", 1)], "kind string, identity string, attempt int, gender string, script string, words int")
        size = len(name.select(surrogates._surrogate("s")).first()[0])
        assert size <= 8 if attempt < 5 else size >= 3 * 2 + 1 + 5 * 2


def test_language_held_out(spark, docs):
    got = {r["doc_id"]: r for r in QUERIES["op8_language"](spark, SF).collect()}
    held = [(got[d]["lang_pred"], lang) for d, t, _, lang in docs if got[d]["held_out"] and t and lang]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_language_masks_hold_every_gram(spark):
    rows = [("der die das", "de"), ("the of and", "en"), ("der die das", "de"), ("the of and", "en")]
    model = language.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["de", "en"]
    assert model.languages_of([" der", " the", " di"]).tolist() == [[1, 0], [0, 1], [1, 0]]
    assert (0 < model.false_rate).all() and (model.false_rate < 0.05).all()


def test_language_false_positives_are_as_many_as_expected(spark):
    """Every n-gram of a language answers, and of n-grams that it does not have as many as its measured rate says."""
    rnd = random.Random(9)
    words = [["".join(chr(first + rnd.randrange(60)) for _ in range(7)) for _ in range(700)] for first in (0x6000, 0x4E00)]
    rows = [(" ".join(w), name) for w, name in zip(words, ("ja", "zh")) for _ in range(2)]
    train = spark.createDataFrame(rows, "text string, lang string")
    for bytes_ in (1 << 24, 50_000):
        model = language.fit_languages(train, false_rate=0.05, slice_bytes=bytes_)
        assert (model.slices > 1) == (bytes_ == 50_000) and (abs(model.false_rate - 0.05) < 0.02).all()
        own = [sorted({f" {w} "[i:i + n] for w in ws for n in (2, 3, 4) for i in range(len(w) + 3 - n)}) for ws in words]
        for i in (0, 1):
            assert model.languages_of(own[i])[:, model.languages.index(("ja", "zh")[i])].all()
            false = model.languages_of(own[i])[:, 1 - i].mean()
            assert abs(false - model.false_rate[1 - i]) < 0.01


def votes_by_hand(text, own):
    """Corrected counts of exact sets of n-grams, which have no false hits."""
    core = [w.strip(language._EDGES) for w in text.lower().split()]
    grams = Counter(f" {w} "[i:i + n] for w in core if any(c.isalpha() for c in w) for n in (2, 3, 4) for i in range(len(w) + 3 - n))
    return {name: sum(n for g, n in grams.items() if g in mine) for name, mine in own.items()}


def test_language_votes_equal_brute_force_but_for_false_positives(spark, docs):
    train = [(t, lang) for d, t, _, lang in docs if t and lang]
    counts = defaultdict(Counter)
    for t, lang in train:
        for w in t.lower().split():
            w = w.strip(language._EDGES)
            if any(c.isalpha() for c in w):
                counts[lang].update(f" {w} "[i:i + n] for n in (2, 3, 4) for i in range(len(w) + 3 - n))
    total = {k: sum(c.values()) for k, c in counts.items()}
    top = defaultdict(float)
    for k, c in counts.items():
        for g, n in c.items():
            top[g] = max(top[g], n / total[k])
    own = {k: {g for g, n in c.items() if n >= 2 and n / total[k] >= 0.2 * top[g]} for k, c in counts.items()}
    model = language.fit_languages(spark.createDataFrame(train, "text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify_languages(spark.createDataFrame([(d, t) for d, t, _, _ in docs], "doc_id bigint, text string"), model).collect()}
    for d, t, _, _ in docs:
        votes = votes_by_hand(t or "", own)
        if sum(votes.values()) > 200:
            best = max(sorted(votes), key=votes.__getitem__)
            assert got[d][0] == best and abs(got[d][1] - votes[best] / sum(votes.values())) < 0.03


def test_language_of_more_than_64(spark):
    rnd = random.Random(6)
    words = {f"l{i:03d}": ["".join(chr(0x5000 + 40 * i + rnd.randrange(40)) for _ in range(5)) for _ in range(30)] for i in range(70)}
    train = spark.createDataFrame([(" ".join(ws), name) for name, ws in words.items() for _ in range(2)], "text string, lang string")
    model = language.fit_languages(train)
    assert len(model.languages) == 70 and model.words == 2
    asked = spark.createDataFrame([(i, " ".join(ws[:10])) for i, ws in enumerate(words.values())], "doc_id int, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify_languages(asked, model).collect()} == dict(enumerate(words))


def test_language_answers_the_same_from_many_slices(spark):
    rnd = random.Random(3)
    spell = lambda first, n: "".join(chr(first + rnd.randrange(600)) for _ in range(n))
    rows = [(i, " ".join(spell(0x4E00 + 700 * (i % 3), 12) for _ in range(160)), "abc"[i % 3]) for i in range(150)]
    asked = [*rows, (None, rows[0][1], None), (None, rows[0][1], None), (900, "1 2 3", None), (901, None, None), (902, "пример", None), (903, rows[1][1].replace(" ", ""), None)]
    train = spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id int, text string, lang string")
    asked = spark.createDataFrame(asked, "doc_id int, text string, lang string")
    whole, cut = language.fit_languages(train, slice_bytes=1 << 30), language.fit_languages(train, slice_bytes=1 << 22)
    assert whole.slices == 1 and cut.slices > 3 and (abs(whole.false_rate - cut.false_rate) < 0.001).all()
    got = [sorted(map(tuple, language.identify_languages(asked, m).collect()), key=str) for m in (whole, cut)]
    assert [r[:2] for r in got[0]] == [r[:2] for r in got[1]] and len(got[0]) == len(rows) + 6
    assert all(abs(a[2] - b[2]) < 0.02 for a, b in zip(*got))
    assert all(pred == "abc"[k % 3] and score > 0.97 for k, pred, score in got[0] if k is not None and k < 150)


def test_language_reads_words_of_any_length(spark):
    rows = [("der die das und nicht " * 20, "de"), ("the of and which was " * 20, "en")]
    model = language.fit_languages(spark.createDataFrame(rows, "text string, lang string"))
    asked = [(1, "1" * 30 + "." + "0" * 60 + "_the_of_and_which_was"), (2, "the" + "_" * 70 + "der_die_das_und_nicht"), (3, "x" * 70_000 + "nicht")]
    asked = spark.createDataFrame(asked, "doc_id int, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify_languages(asked, model).collect()} == {1: "en", 2: "de", 3: "de"}
    long = language.fit_languages(spark.createDataFrame([("x" * 100 + "der", "de"), ("x" * 100 + "der", "de")], "text string, lang string"), slice_bytes=256)
    assert long.languages_of(sorted({f" {'x' * 100}der "[i:i + n] for n in (2, 3, 4) for i in range(106 - n)})).all()
    assert [r["lang_pred"] for r in language.identify_languages(asked, long).collect()] == ["de"] * 3
    for word in ("ab" * 100_000 + "c", "x" * 59 + "yz"):  # the slices of a long word hold each n-gram once
        parts = np.concatenate(list(language._long_keys(word)))
        assert sorted(parts) == sorted(language._word_keys([word])[0])


def templates_by_hand(text):
    out, opened, number = [], True, False
    for token in re.findall(r"\n|[^\s]+", text):
        if token == "\n":
            opened = True
            continue
        core = token.strip(decontaminate._EDGES)
        if core:
            low = core.lower()
            if re.fullmatch(r"[$€£]?[+-]?\d[\d.,:/]*%?", core):
                out.append(("#", "#", low))
            elif number and low in decontaminate.UNITS:
                out.append(("u", "u", low))
            elif not opened and len(core) > 1 and core[0].isupper() and core[1:].islower():
                out.append(("N", low, low))
            else:
                out.append((low, low, None))
            number, opened = out[-1][0] == "#", False
        opened = opened or token[-1] in ".!?:"
    return out


def passages_by_hand(texts, items, size=13):
    found = set()
    prepared = {i: templates_by_hand(t) for i, t in items}
    for key, text in texts:
        words = templates_by_hand(text)
        for item, known in prepared.items():
            width = min(size, len(known))
            if width < 5:
                continue
            aligned = defaultdict(list)
            for a in range(len(known) - width + 1):
                for b in range(len(words) - width + 1):
                    x, y = known[a:a + width], words[b:b + width]
                    if [x[0][1], *(w[0] for w in x[1:])] != [y[0][1], *(w[0] for w in y[1:])]:
                        continue
                    if sum(w not in "#uN" for w in [x[0][1], *(w[0] for w in x[1:])]) < (width + 1) // 2:
                        continue
                    pairs = [(p[2], q[2]) for i, (p, q) in enumerate(zip(x, y)) if (p[1] in "#u" if i == 0 else p[0] in "#uN")]
                    if len(set(pairs)) == len({p for p, _ in pairs}) == len({q for _, q in pairs}):
                        aligned[b - a].append(pairs)
            for lists in aligned.values():
                pairs = {p for one in lists for p in one}
                if len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs}):
                    found.add((key, item))
    return found


def test_passages_are_those_of_brute_force(spark):
    item = "A train leaves with 40 people and 3 cars. At the first stop Tom and 40 others get off after 5 km of slow travel today."
    swapped = "so then a train leaves with 62 people and 9 cars. At the first stop Anna and 62 others get off after 8 km of slow travel today and more"
    broken = "a train leaves with 62 people and 9 cars. At the first stop Anna and 63 others get off after 8 miles of quick travel later"
    texts = [(1, "intro words. " + item + " outro"), (2, swapped), (3, broken), (4, "nothing of this kind is in here at all, not even a little part of it"),
             (5, "ONE two three four five SIX"), (6, "one two three four five seven")]
    items = [(10, item), (20, "one two three four five six"), (30, "too few words"), (40, "1 2 3 4 5 6 7 8 9")]
    got = decontaminate.find_passages(spark.createDataFrame(texts, "file bigint, value string"), spark.createDataFrame(items, "template bigint, value string")).collect()
    assert {(r["file"], r["template"]) for r in got} == passages_by_hand(texts, items)
    assert {(r["file"], r["template"], r["changed"]) for r in got} >= {(1, 10, False), (2, 10, True), (5, 20, False)}


def test_passages_of_few_literal_words_are_found_verbatim(spark):
    scores = "12 15 18 21 24 27 30 33 36 39 42 45 48 51 54"
    names = "We met Anna Berta Carla Dora Emma Frida Gerda Hanna Ida Jana Klara Lena Mona there"
    items = [(1, scores), (2, names), (3, "7 km 8 km 9 km sum 24 km")]
    texts = [(10, f"intro {scores} outro"), (11, scores.replace("33", "34")), (12, f"Yesterday was fine. {names} again"), (13, names.replace("Gerda", "Gisela")),
             (14, "The table:\n7 km 8 km 9 km sum 24 km"), (15, "7 km 8 km 9 km sum 25 km"), (16, "km " + scores.replace(" 39", "\n39"))]
    got = decontaminate.find_passages(spark.createDataFrame(texts, "file bigint, value string"), spark.createDataFrame(items, "template bigint, value string")).collect()
    assert {(r["file"], r["template"], r["changed"]) for r in got} == {(10, 1, False), (12, 2, False), (14, 3, False), (16, 1, False)}
    assert {r["file"]: (r["start"], r["n_windows"], r["n_words"]) for r in got if r["template"] == 1} == {10: (1, 3, 15), 16: (1, 3, 15)}


def test_passages_with_one_changed_repeated_value_are_found(spark):
    filler = ["the old mill beside the quiet river was built by two brothers who came from far away", "and every spring the whole village walked up the hill to look at the wide green fields"]
    item = f"in 1990 {filler[0]} and in 1990 {filler[1]} until 1990 came"
    one, two = item.replace("until 1990", "until 1991"), item.replace("in 1990 the", "in 1985 the").replace("until 1990", "until 1991")
    # changed windows that contradict each other (both values of 1990), without any unchanged one
    torn = "on 5 May all of the old men of our town met 5 more men of the other town and on 5 June none came back to the fair again"
    items = [(1, item), (2, torn)]
    texts = [(10, item), (11, one), (12, two), (13, torn.replace("met 5", "met 6").replace("on 5 June", "on 7 June").replace("on 5 May", "on 8 May"))]
    got = decontaminate.find_passages(spark.createDataFrame(texts, "file bigint, value string"), spark.createDataFrame(items, "template bigint, value string")).collect()
    assert {(r["file"], r["template"]) for r in got} == {(10, 1), (11, 1), (12, 1)}
    assert {r["file"]: r["changed"] for r in got} == {10: False, 11: True, 12: False}  # in 12 only the unchanged windows count


def test_passages_in_given_tables(spark, docs):
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op9_decontaminate"](spark, SF).collect()}

    def words(t):
        return [w.strip(decontaminate._EDGES).lower() for w in (t or "").split() if w.strip(decontaminate._EDGES)]
    shared = set()
    known = defaultdict(set)
    for i, t in items:
        w = words(t)
        for a in range(max(1, len(w) - 12)):
            known[tuple(w[a:a + 13])].add(i)
    for d, t, *_ in docs:
        w = words(t)
        for a in range(len(w) - 12):
            shared |= {(d, i) for i in known.get(tuple(w[a:a + 13]), ())}
    assert shared <= got and {d for d, _ in got} == {d for d, _ in shared}


def test_near_images_recall(spark):
    rnd = np.random.default_rng(2)
    rows, n = [], 0
    for label in (0, 0, 0, 1, 2):  # label 0 holds most rows; one tight cluster, copies, pairs on both sides of the threshold
        centre = rnd.standard_normal((400, 16))
        for c in centre:
            rows.append((n, c.tolist(), label))
            n += 1
            if n % 4 == 0:
                rows.append((n, (c * 2 + rnd.standard_normal(16) * rnd.choice([0.0, 0.1, 0.4])).tolist(), label))
                n += 1
        tight = rnd.standard_normal(16)
        for _ in range(150):
            rows.append((n, (tight + rnd.standard_normal(16) * 0.05).tolist(), label))
            n += 1
    images = spark.createDataFrame(rows, "pid bigint, pixels array<double>, optics_group int")
    got = {r["pid"]: r for r in vector_forest.near_equal_images(images, leaf=60, sample=500, block=100).collect()}
    x, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    norm = np.linalg.norm(x, axis=1)
    linked = (x @ x.T / np.outer(norm, norm) >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    mine = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (mine <= linked.sum(1)).all() and mine.sum() >= 0.97 * linked.sum()
    whole = reach(range(len(rows)), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked))])
    assert np.mean([got[i]["component_id"] == whole[i] for i in whole]) >= 0.98


def test_bloom_keeps_all_its_keys(spark):
    rows = spark.range(2000)
    gone = spark.range(0, 2000, 3).toDF("k")
    assert {r["id"] for r in bloom.without_keys(rows, "id", gone).collect()} == {i for i in range(2000) if i % 3}
