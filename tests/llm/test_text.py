"""Text operators: exact round trips, brute force on small fixtures, held-out accuracy, edge cases."""

import itertools
import json
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from busweave.llm import canon, mixing, names, subjects, tokenize

from ..conftest import rows


# ---- tokenizer ---------------------------------------------------------------------------------------------------------------

TEXTS = [None, "", " ", "\n\n  x", "Hello world, it's 2024!", "Größe 12,5 €/MWh — naïve façade", "水位 ток 🙂⚡ مستوى", "<|endoftext|> is text", "aaaaaaaaaaaaaaaaaaaaaaaa", "a" * 5000 + " " + "\t" * 300, "don't we'll I'd", "​zero​width", "x" * 200_000]


def _reference_tokenizer():
    tok = pytest.importorskip("tokenizers")
    path = os.path.join(tokenize.tokenizer_dir(), "byte_bpe_50k.json")
    if not os.path.exists(path):
        pytest.skip("no vocabulary")
    t = tok.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_public_encoder(spark):
    t = _reference_tokenizer()
    df = spark.createDataFrame([(i, x, "extra") for i, x in enumerate([*TEXTS, TEXTS[5]])], "doc_id long, text string, ids string")
    got = dict(rows(tokenize.encode_texts(df, ["doc_id"]), "doc_id", "ids"))
    assert len(got) == len(TEXTS) + 1
    for i, x in enumerate([*TEXTS, TEXTS[5]]):
        assert list(got[i]) == t.encode(x or "", add_special_tokens=False).ids
    counts = dict(rows(tokenize.encode_texts(df, ["doc_id"], counts_only=True), "doc_id", "n_tokens"))
    assert counts == {i: len(v) for i, v in got.items()}
    assert tokenize.encode_texts(df.limit(0), ["doc_id"]).count() == 0
    both = tokenize.encode_texts(df.select("doc_id", "text"), ["doc_id", "text"]).where("doc_id = 4").first()
    assert both.text == TEXTS[4] and list(both.ids) == list(got[4])
    with pytest.raises(ValueError):
        tokenize.encode_texts(df, ["ids"])


def test_pair_index_on_random_words():
    t = _reference_tokenizer()
    enc = tokenize.PairEncoder(os.path.join(tokenize.tokenizer_dir(), "byte_bpe_50k.json"))
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abeinrst"), int(n))) for n in rng.integers(1, 40, 500)]
    for w, ids in zip(words, enc.encode([w.encode() for w in words])):
        assert ids == t.encode(w, add_special_tokens=False).ids


# ---- canonical values --------------------------------------------------------------------------------------------------------

CANON = [(108, "country", "Germany", "DE|DEU|Deutschland"), (102, "country", "Austria", "AT|AUT|Österreich"), (114, "country", "United Kingdom", "GB|GBR|Great Britain"), (132, "country", "Slovenia", "SI|SVN"), (133, "country", "Slovakia", "SK|SVK|Slovensko"), (204, "fuel_group", "gas", "natural gas|B04"), (203, "fuel_group", "hard_coal", "hard coal|B05"), (202, "fuel_group", "lignite", None)]


def test_mapping(spark):
    c = spark.createDataFrame(CANON, "ref_id int, field_name string, canon_value string, other_names string")
    typed = {
        "Germany": None, None: None, "  ": None, "": None, " Germany ": 108, "gERMANY": 108, "Gеrmаnу": 108, "Germny": 108, "DE00": 108, "de": 108, "DE-mainland": 108, "Germany (mainland)": 108, "Kingdom, United": 114, "Unite.": 114, "State of Austria": 102,
        "Austrai": 102, "Australia": 0, "Austrasia": 0, "Slavonia": 0, "Slove.": 132, "Slovnia": 132, "Osterreich": 102, "EU27": 0, "?": 0, "12": 0, "xyz" * 20_000: 0, "​Deutschland\t": 108,
    }
    fuels = {"gas": None, "Erdgas": 204, "b04": 204, "hard-coal.": 203, "hrad coal": 203, "Steinkohle": 203, "brown coal": 0, "lignit": 202, "solar PV": 0, "B10 5": 0}
    data = [("t", i, "country", v, "x") for i, v in enumerate(typed)] + [("f", i, "fuel_group", v, "x") for i, v in enumerate(fuels)] + [("t", 4, "country", " Germany ", "x")]
    df = spark.createDataFrame(data, "table_name string, row_id long, field_name string, value string, ref_id string")
    got = {(t, v): r for t, v, r in rows(canon.map_values(df, c, names.known_of(c)), "table_name", "value", "ref_id")}
    for v, r in typed.items():
        assert got.get(("t", v)) == r, v
    for v, r in fuels.items():
        if v != "brown coal":  # a known name of lignite elsewhere, near to hard coal here
            assert got.get(("f", v)) == r, v
    assert canon.map_values(df.limit(0), c, names.known_of(c)).count() == 0
    empty = canon.map_values(df, c.limit(0), names.known_of(c.limit(0)))
    assert empty.where("ref_id <> 0").count() == 0


def test_similarity_join_loses_nothing(spark):
    """The prefix-filter join against all pairs."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcde"), int(rng.integers(3, 9))))
    left, right = [f"{word()} {word()}" for _ in range(60)], [f"{word()} {word()}" for _ in range(40)]
    make = lambda xs, ident, text: spark.createDataFrame([("f", i, x) for i, x in enumerate(xs)], f"field_name string, {ident} long, {text} string").withColumn("tokens", canon.tokens(F.col(text)))
    l, r = make(left, "form_id", "form").withColumn("value_id", F.col("form_id")), make(right, "name_id", "name").withColumns({"ref_id": F.col("name_id"), "origin": F.lit(0)})
    tl, tr = {x.form_id: set(x.tokens) for x in l.collect()}, {x.name_id: set(x.tokens) for x in r.collect()}
    for least in (0.3, 0.5):
        want = sorted((i, j) for i, j in itertools.product(tl, tr) if len(tl[i] & tr[j]) / len(tl[i] | tr[j]) >= least)
        assert rows(canon._similar(l, r, least), "value_id", "ref_id") == sorted(want, key=repr)


def test_country_names_come_from_locale_data(spark):
    c = spark.createDataFrame([(1, "country", "Germany", "DE|DEU"), (2, "country", "Austria", "AT"), (3, "country", "Atlantis", "QQ"), (4, "fuel_group", "gas", "B04")], "ref_id int, field_name string, canon_value string, other_names string")
    own, others = names.country_names(c)
    assert set(own) == {"Germany", "Austria"} and {"Allemagne", "Alemania", "Saksa"} <= set(own["Germany"]) and {"Australia", "Australien", "Australie"} <= set(others) and "Germany" not in others
    df = spark.createDataFrame([("t", i, "country", v) for i, v in enumerate(["Allemagne", "Alemagne", "Austria.", "Australien", "Autsria", "A", "é"])], "table_name string, row_id long, field_name string, value string")
    assert [r[1] for r in rows(canon.map_values(df, c, names.known_of(c)), "row_id", "ref_id")] == [1, 1, 2, 0, 2, 0, 0]


# ---- mixing ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 1000, 4097])
def test_permutation(n):
    got = mixing.permute(np.arange(n), n, 7)
    assert sorted(got) == list(range(n))
    assert n < 5 or list(got) != list(range(n))


def test_mix(spark):
    docs = [(i, s, f"word{i} and some more text about {s} " * (1 + i % 7), "x") for i, s in enumerate(["big"] * 300 + ["small"] * 20 + ["other"] * 30)]
    docs += [(900, "big", None, "x"), (901, "big", "", "x"), (902, None, "no source", "x"), (903, "small", "very long " * 3000, "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, block string").drop("block")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("absent", 0.2, 5)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(df, targets, block=16, per_shard=32)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "small", "absent"} and r["absent"].mixed_tokens == 0
    assert r["big"].reached_share == pytest.approx(0.625, abs=0.02) and r["small"].reached_share == pytest.approx(0.375, abs=0.02)
    got = mixed.collect()
    assert sum(x.n_tokens for x in got) == sum(x.mixed_tokens for x in r.values())
    assert len({(x.shard, x.slot) for x in got}) == len(got) and max(x.slot for x in got) < 32
    uses: dict = {}
    for x in got:
        uses.setdefault((x.source, x.block), []).append(x.turn)
    caps = {"big": 1, "small": 3}
    assert all(len(t) <= caps[s] and len(set(t)) == len(t) for (s, _), t in uses.items())
    # Blocks of a source, put together, are its documents' tokens: nothing lost or doubled.
    packed = mixing.pack(mixing.encoded_sources(df.repartition(5), targets))
    blocks = {(b.source, b.block): list(b.ids) for b in mixing.blocks_of(packed, 16).collect()}
    assert max(t for _, t in [(k, len(v)) for k, v in blocks.items()]) == 16
    for s in ("big", "small"):
        flat = [t for k in sorted(k for k in blocks if k[0] == s) for t in blocks[k]]
        want = [t for p in sorted(packed.where(F.col("source") == s).collect(), key=lambda p: p.start) for t in p.ids]
        assert flat == want and len(flat) == r[s].tokens
    again = mixing.mix(df, targets, block=16, per_shard=32)[0]
    assert rows(again, "shard", "slot", "source", "block") == rows(mixed, "shard", "slot", "source", "block")


def test_shards_draw_multinomial_counts_and_totals_are_exact(spark):
    """Shards differ as multinomial draws do, every number of a source is used once, and what was moved lies all over the shards."""
    plan = pd.DataFrame({"source": ["a", "b", "c"], "slots": [50_000, 30_000, 20_007], "blocks": [25_000, 30_000, 7_000]})
    slots = mixing.draw_slots(spark, plan, 1000).toPandas()
    assert len(slots) == 100_007 and not slots.duplicated(["shard", "slot"]).any() and not slots.duplicated(["source", "block", "turn"]).any()
    assert slots.groupby("source").size().to_dict() == {"a": 50_000, "b": 30_000, "c": 20_007}
    assert (slots[slots["shard"] < 100].groupby("shard")["slot"].agg(["min", "max"]) == [0, 999]).all().all() and (slots["shard"] == 100).sum() == 7
    per = slots[(slots["source"] == "a") & (slots["shard"] < 100)].groupby("shard").size()
    assert 0.6 < per.std() / np.sqrt(1000 * 0.5 * 0.5) < 1.5
    drawn = mixing.draw_counts(spark, plan, 1000).toPandas()
    first = drawn[drawn["shard"] == 3].set_index("k")["n"]
    now = slots[slots["shard"] == 3].groupby("source").size()
    assert abs(first.loc[0] - now["a"]) < 30  # only a few slots of a shard are moved
    again = mixing.draw_slots(spark, plan, 1000).toPandas()
    key = ["shard", "slot"]
    assert slots.sort_values(key, ignore_index=True).equals(again.sort_values(key, ignore_index=True))


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(df, targets)
    assert mixed.count() == 0 and report.first().reached_share == 0


# ---- subjects ----------------------------------------------------------------------------------------------------------------

WATER = ["The river rose after the snow melt.", "Inflow at the dam fell short of the mean.", "The reservoir kept the spillway busy.", "Snow cover fed the upper river."]
TRADE = ["The price closed at forty euro.", "A bid in the auction rewarded sellers.", "The spread between zones shifted rent.", "Trade in futures hedged the price."]
SPORT = ["The club won the cup match.", "A runner led the race on the last lap.", "The team scored before the final whistle.", "The match ended in a draw."]
FILL = ["See the list further down.", "Figures are rounded.", "A second note follows."]


def _corpus(seed, n=300):
    rng = np.random.default_rng(seed)
    pools, docs, truth = [WATER, TRADE, SPORT], [], {}
    for i in range(n):
        main = [int(rng.integers(3))] + ([int(rng.integers(3))] if rng.random() < 0.4 else [])
        s, about = [], []
        for _ in range(int(rng.integers(5, 12))):
            k = -1 if rng.random() < 0.1 else main[int(rng.integers(len(main)))]
            pool = FILL if k < 0 else pools[k]
            x = pool[int(rng.integers(len(pool)))]
            if k >= 0 and rng.random() < 0.2:
                other = pools[(k + 1) % 3]
                x = x[:-1] + f", unlike {other[int(rng.integers(4))][:-1].lower()}."
            s.append(x)
            about.append(k)
        docs.append((i, " ".join(s) + ("\nMarket desk and sport desk share one price." if i % 3 == 0 else ""), "en"))
        truth[i] = {k + 1 for k in range(3) if about.count(k) >= 0.25 * len(about)}
    return docs, truth


def test_subjects_held_out(spark):
    docs, truth = _corpus(1)
    docs += [(900, None, None), (901, "", "en"), (902, "12;34\n==", "en"), (903, WATER[0] + " " + WATER[1], "en"), (904, ("<p>" + TRADE[0] + "</p>\n") * 4000, "xx")]
    df = spark.createDataFrame(docs, "doc_id long, text string, share string")
    ex = [(k + 1, " ".join(p[j : j + 2]), "en") for k, p in enumerate([WATER, TRADE, SPORT]) for j in (0, 1, 2)] + [(3, WATER[0] + " " + WATER[2], "en"), (None, "x y z", "en"), (1, None, "en")]
    e = spark.createDataFrame(ex, "subject_id int, text string, lang string")
    coded = subjects.encode_corpus(df, subjects.repeated_footers(df))
    models = subjects.train(coded, e, [1, 2, 3])
    got: dict = {}
    for d, s in rows(subjects.assign_subjects(coded, models, [1, 2, 3]), "doc_id", "subject_id"):
        got.setdefault(d, set()).add(s)
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right / len(truth) > 0.97
    assert 900 not in got and 901 not in got and 902 not in got and got[903] == {1} and got[904] == {2}
    assert subjects.assign_subjects(coded.limit(0), models, [1, 2, 3]).count() == 0


def test_words_and_pairs_have_rows_of_their_own(spark):
    # "river" and the foreign word once shared a row of the word table; thousands of rare words share rows of any small table.
    old_row = lambda w: zlib.crc32(subjects.fold_word(w).encode()) % 32767
    foreign = next(w for w in ("".join(t) for t in itertools.product("abdghk", repeat=7)) if old_row(w) == old_row("river"))
    rng = np.random.default_rng(2)
    names = ["".join(rng.choice(list("abdghklmnoptuvw"), 8)) for _ in range(40_000)]
    docs = [(i, " ".join(names[40 * i : 40 * i + 40]) + ".") for i in range(1000)] + [(1000 + i, WATER[i % 4] + " " + TRADE[i % 4]) for i in range(40)] + [(2000, f"{foreign} {foreign} {foreign}.")]
    coded = subjects.encode_corpus(spark.createDataFrame(docs, "doc_id long, text string"), subjects.Footers())
    e = spark.createDataFrame([(k + 1, x, "en") for k, p in enumerate([WATER, TRADE]) for x in p], "subject_id int, text string, lang string")
    models = subjects.train(coded, e, [1, 2], rounds=1)
    at = models.places.ids(pa.array(["river", foreign, "nowhere at all"]))
    assert at[0] != at[1] and at[2] == models.places.n_words - 1
    # No pair is likelier than certain: what a pair counts is part of what its first word does.
    before = models.places.pairs // models.places.n_words
    assert (models.pairs[:-1] <= models.contexts[before] * (1 + 1e-4) + 1e-6).all()
    distinct = {(a, b) for _, t in docs for s in subjects.sentences(t) for a, b in zip([""] + s, s)} | {(a, b) for p in (WATER, TRADE) for t in p for s in subjects.sentences(t) for a, b in zip([""] + s, s)}
    assert len(models.places.pairs) == len({(subjects.fold_word(a), subjects.fold_word(b)) for a, b in distinct})


def test_no_examples(spark):
    df = spark.createDataFrame([(1, WATER[0])], "doc_id long, text string")
    e = spark.createDataFrame([], "subject_id int, text string, lang string")
    coded = subjects.encode_corpus(df, subjects.Footers())
    assert subjects.assign_subjects(coded, subjects.train(coded, e, [1, 2]), [1, 2]).count() == 0


def _footers(*lines):
    shapes = [subjects.line_shape(x) for x in lines]
    return subjects.Footers({subjects.Footers.digest(x): subjects.Footers.head(x) for x in shapes})


def test_footers_of_any_length_and_place(spark):
    """Footers of thousands of characters, before thousands of blank lines, with any number in them, in decomposed letters or not."""
    long = "terms of use " * 300 + "apply on page 12."
    docs = [(i, f"A note about nothing, number {i * i}.\n{long.replace('12', str(i * 10**40))}" + "\n \n" * 4000) for i in range(8)] + [(9, None), (10, ""), (11, "\n\n")]
    found = subjects.repeated_footers(spark.createDataFrame(docs, "doc_id long, text string"), share=0.5)
    assert len(found.digests) == 2 and long in found and long.replace("12", "7" * 60) in found and long + "x" not in found
    assert subjects.sentences(f"The river rose again.\n{long}", found) == [["the", "river", "rose", "again"]]
    numbered = _footers("7" * 50 + " pages were printed today.")
    assert ("8" * 90 + " pages were printed today.") in numbered and "pages were printed today." not in numbered and "x" not in subjects.Footers()
    tag = "<p title='" + "long " * 50 + "'>The river rose again.</p> It was 3 < 4 then."
    assert subjects.sentences(tag)[0] == ["the", "river", "rose", "again"]


def _trained(labelled):
    ex = subjects.Examples.read(labelled)
    places = subjects.Places(pa.array(sorted(set(ex.words))))
    ex.place(places)
    places.pairs = np.unique(places.numbers(ex.before, ex.ids))
    ex.place(places)
    return ex, np.full(places.n_words, 1 / places.n_words)


def test_examples_are_held_out_exactly():
    labelled = sorted((k, x, "en") for k, p in enumerate([WATER, TRADE, SPORT]) for x in p)
    ex, background = _trained(labelled)
    w = np.zeros((len(ex.label), 4))
    w[np.arange(len(ex.label)), ex.label] = 1
    models = subjects.Models(*ex.counts(w), background, ex.places)
    for i, out in ((0, [0]), (3, [3, 5]), (11, [11, 0, 4])):
        less = w.copy()
        less[out] = 0
        ids, before, pair, starts = ex.part(i)
        want = subjects.Models(*ex.counts(less), background, ex.places).gain(ids, before, pair, starts)
        assert np.allclose(models.gain_without(ex, w, i, out), want, atol=1e-4)


def test_acceptance_is_calibrated_on_held_out_examples():
    """A subject that takes the examples of others is held back; subjects told apart as they are keep their weight."""
    labelled = sorted((k, x, "en") for k, p in enumerate([WATER, TRADE, SPORT]) for x in p)
    ex, background = _trained(labelled)
    w = np.zeros((len(ex.label), 4))
    w[np.arange(len(ex.label)), ex.label] = 1
    fair = subjects.Models(*ex.counts(w), background, ex.places)
    greedy = [c.copy() for c in ex.counts(w)]
    for c in greedy[:1]:
        c[:, 2] += 1.2 * c[:, :2].sum(axis=1)  # sport has heard of everything
    tuned = subjects.calibrated(subjects.Models(*greedy, background, ex.places), ex, w, 1.0)
    right = lambda m, lean: sum(int((m.sharpness * m.gain_without(ex, w, i, [i])[:, :3].sum(axis=0) + lean[:3]).argmax() == ex.label[i]) for i in range(len(ex.label)))
    assert right(tuned, tuned.lean) >= right(tuned, np.zeros(4)) and tuned.lean[3] == 0
    kept = subjects.calibrated(fair, ex, w, 1.0)
    assert right(kept, kept.lean) >= right(kept, np.zeros(4))


def test_sentences():
    text = "<p>The RIVER rose, unlike the price of gas. It fell 12 per cent!</p>\n* for i in range(9):\nx[i] = 2\na broken li-\nne ends here. FOOTER 2024 stays out."
    got = subjects.sentences(text, _footers("footer 7 is not this"))
    assert got[0] == ["the", "river", "rose"] and got[1] == ["it", "fell", "12", "per", "cent"] and ["a", "broken", "line", "ends", "here"] in got
    assert subjects.word_id("moment") == subjects.word_id("m0ment") == subjects.word_id("mornent")


def test_queries_run(spark, sf_dir):
    from busweave.llm.queries import QUERIES

    for name, q in QUERIES.items():
        df = q(spark, sf_dir)
        assert df.columns and df.count() >= 0, name
    assert json.dumps(sorted(QUERIES))
