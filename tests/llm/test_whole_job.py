"""Cases of the first advice: what an operator must do for the whole job."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ampline.llm import curriculum, jaccard, registry, simhash, surrogates


def near_texts(rng, n):
    """Texts of n words that differ from the first in the given number of single words."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(n)]

    def changed(k):
        t = list(base)
        for i in range(k):
            t[(2 * i + 1) * n // (2 * k)] = f"new{rng.randrange(10**6)}"
        return " ".join(t)

    return " ".join(base), changed


@pytest.mark.parametrize("small", [8, 1])
def test_similar_groups_lose_no_pair(spark, small):
    rng = random.Random(5)
    texts = [None, "", " \t", "one two", "One  TWO", "one two three"]
    for n in (6, 9, 30, 60, 150, 400):
        base, changed = near_texts(rng, n)
        texts += [base, base.upper(), *[changed(k) for k in range(1, 1 + max(3, n // 30))], base + " and more", "prefix " + base]
    texts += [" ".join(["same line of junk"] * 20 + [f"x{i}"]) for i in range(12)]
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            root[i] = min(root[j] for j, b in enumerate(sets) if a == b or 5 * len(a & b) >= 4 * len(a | b))
    df = spark.createDataFrame(list(enumerate(texts)), "r long, text string").repartition(3)
    got = {x.row: x.component for x in jaccard.similar_groups(df, "r", small=small).collect()}
    assert [got[i] for i in range(len(texts))] == root
    assert jaccard.similar_groups(df.limit(0), "r").count() == 0


def test_rows_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Texts of which half of the pairs are just not similar make links in proportion to their number, and no link is lost."""
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = []
    for i in range(160):
        t = list(base)
        for k in rng.sample(range(40), 2 + i % 2):  # a change at every fifth word is one of five shingles
            t[5 * k] = f"new{i}x{k}"
        texts.append(" ".join(t))
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    near = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if 5 * len(a & b) >= 4 * len(a | b)]
    assert len(near) > 10 * len(texts)
    root = list(range(len(texts)))
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    made, write = [], jaccard.stage

    def stage(df):
        out = write(df)
        if out.columns == ["a", "b"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stage", stage)
    monkeypatch.setattr(jaccard, "HELD", 5_000)  # most sets are read from the file
    df = spark.createDataFrame(list(enumerate(texts)), "r long, text string").repartition(3)
    got = {x.row: x.component for x in jaccard.similar_groups(df, "r").collect()}
    assert [got[i] for i in range(len(texts))] == root
    assert max(made) <= 8 * len(texts), made


@pytest.mark.parametrize("distance", [4, 5, 6, 8])
def test_fingerprint_links_join_all_rows_in_reach(spark, distance):
    rng = random.Random(distance)
    texts = [None, "", "one", "ONE"]
    for n in (12, 40, 120, 300):
        base, changed = near_texts(rng, n)
        texts += [base, base.upper(), *[changed(k % 4 + 1) for k in range(25)]]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    root, want = list(range(len(texts))), list(range(len(texts)))
    got = simhash.near_rows(spark.createDataFrame(list(enumerate(texts)), "r long, text string").repartition(3), "r", size=5, distance=distance).collect()
    assert all(x.a < x.b for x in got)
    for _ in texts:
        for i, f in enumerate(prints):
            want[i] = min(want[j] for j, g in enumerate(prints) if (f ^ g).bit_count() <= distance)
        for x in got:
            root[x.a] = root[x.b] = min(root[x.a], root[x.b])
    assert root == want


def test_pipeline_links_near_fingerprints_first(spark, monkeypatch):
    """The stage's first links are those of the fingerprints; what they link wrongly is parted, what they miss is found."""
    base, changed = near_texts(random.Random(7), 200)
    other, _ = near_texts(random.Random(8), 200)
    df = spark.createDataFrame([(1, base), (2, changed(1)), (3, changed(3)), (4, other)], "doc_id long, text string")
    told, linked = [], simhash.near_rows
    monkeypatch.setattr(simhash, "near_rows", lambda *a, **k: told.append((k["size"], linked(*a, **k))) or told[-1][1])
    groups = jaccard.similar_groups
    monkeypatch.setattr(jaccard, "similar_groups", lambda *a, **k: told.append(k["links"].count()) or groups(*a, **k))
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [1, 4]
    assert told[0][0] == jaccard.SHINGLE and told[1] >= 1
    rows = spark.createDataFrame([(0, base), (1, changed(1)), (2, other)], "r long, text string")
    wrong = spark.createDataFrame([(0, 2), (1, 2), (2, 9)], "a long, b long")
    assert {x.row: x.component for x in groups(rows, "r", links=wrong).collect()} == {0: 0, 1: 0, 2: 2}


def test_curriculum_is_range_sorted(spark, tmp_path):
    """op9's documents stand in the order of their first training time, over partitions too; ties by their place."""
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 9)) or None, ["a", "a", "b", "c", "c", None, None][rng.randrange(7)]) for i in range(900)]
    rows += [(None, None, None), rows[3], rows[3]]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.op9_curriculum(spark, str(tmp_path)).collect()
    first = [2 if r.first_position is None else r.first_position for r in got]
    assert len(got) == len(rows) and first == sorted(first) and 2 in first and len(set(first)) > 300
    assert [r.doc_id for r in registry.op9_curriculum(spark, str(tmp_path)).collect()] == [r.doc_id for r in got]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    parts = curriculum.curriculum(docs, ["doc_id"], partitions=12).withColumn("part", F.spark_partition_id()).collect()
    assert len({r.part for r in parts}) == 12 and "__place" not in parts[0].asDict()
    out = [r.part for r in parts if not r.positions]
    assert len(set(out)) > 1  # documents that are left out do not meet in one task
    copies = curriculum.training_order(curriculum.schedule(docs, ["doc_id"]), 4).collect()
    assert [r.position for r in copies] == sorted(r.position for r in copies) and "__place" not in copies[0].asDict()
    assert sum(r["size"] for r in copies) == sum(r.taken for r in got)


def test_pipeline_drops_similar_texts(spark):
    base, changed = near_texts(random.Random(7), 200)
    other, _ = near_texts(random.Random(8), 200)
    df = spark.createDataFrame([(1, base), (2, changed(3)), (3, changed(9)), (4, other)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == [1, 3, 4]


def test_pipeline_keeps_one_row_a_group(spark):
    rng = random.Random(9)
    bases = [near_texts(rng, 60) for _ in range(5)]
    (a, a2), (b, _), (c, _), (d, _), (e, e2) = bases
    rows = [
        (1, a), (1, a), (2, a2(1)),  # a repeated row
        (None, b), (None, b),  # a group without ids
        (None, c), (5, c), (None, c),  # null ids beside an id
        (7, d), (7, e), (7, e2(1)),  # an id with several texts
        (None, None), (None, ""),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 0, 1, 5, 7, 7]
    assert {r.text for r in got} >= {a, b, c, d}


def test_numbers_side_by_side(spark):
    card, amex, bad = "4041 8949 7460 8795", "378282246310005", "4041894974608796"
    cases = {
        "123-45-6789 987-65-4321": ("ssn", 2), "555-123-4567 555-987-6543 555-111-2222": ("phone", 3), "call 555-123-4567 100 times": ("phone", 1),
        "1234 123-45-6789": ("ssn", 1), f"{card} 123-45-6789": ("card,ssn", 2), f"12 {card.replace(' ', '')} 100": ("card", 1), f"1234 {card}": ("card", 1),
        f"{card} 1234 5678": ("card", 1), f"{amex} {amex} {bad}": ("card", 2), bad: ("", 0), "40418 9497460 8795": ("card", 1), " ".join(["7"] * 3000): ("", 0),
        f"{bad} {card} 555-123-4567": ("card,phone", 2), "a 1 b": ("", 0),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    for r in surrogates.replace_entities(df, "k").collect():
        before, (types, n) = list(cases.items())[r.i]
        assert (r.entity_types, r.n_entities) == (types, n), before[:60]
        assert len(r.text) == len(before) and (n > 0) == (r.text != before)
        for gone in ("123-45", "987-65", "555-", "8795", amex):
            assert gone not in r.text
        assert all(w in r.text for w in ("call", "100 times", bad, "1234 5678") if w in before)


def test_secrets_to_their_end(spark):
    rng = random.Random(4)
    part = lambda n: "".join(rng.choice("abcdefXYZ0123456789") for _ in range(n))
    long, head, body, sign = part(300), part(36), part(400), part(43)
    cases = [f"token={long} end.", f"token: {head}.{body}.{sign}. Next", f"api_key = '{long}=='", f"ghp_{long} x", f"password: {head[:12]}. Then", f"xoxb-{head}-{body}.", "token=abc.defgh"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, text string")
    for r in surrogates.replace_entities(df, "k").collect():
        before = cases[r.i]
        assert r.entity_types == "secret" and r.n_entities == 1 and len(r.text) == len(before)
        for s in (long, head, body, sign):
            for at in range(0, len(s) - 11):
                assert s[at : at + 12] not in r.text
        assert r.i not in (0, 1, 3, 4) or r.text.endswith(before[before.rindex(" ") :])


def mod97(iban):
    iban = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def luhn(number):
    d = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10


def replaced(spark, cases, key="k"):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(cases)], "i int, text string, entity_types string").repartition(3)
    return {r.i: r for r in surrogates.replace_entities(df, key).collect()}


def test_nothing_leaks(spark):
    gone = {
        "token=1234567890123 end": (["1234567890123"], "secret"), "password: Hunterxyz": (["Hunterxyz"], "secret"), "pay DE89 3704 0044 0532 0130 00 now": (["3704", "0532"], "iban"),
        "Mr. SMITH left": (["SMITH"], "name"), "Dr. Anna Smith, Prof. Lee": (["Anna", "Smith", "Lee"], "name"), "ring 02079460958 or 555-123-4567": (["02079460958", "555-123"], "phone"),
        "at 2001:db8::1 and fe80::1 and 2001:db8:0:1:1:1:1:1": (["2001:db8", "fe80::1"], "ip6"), "mail name@exämple.de, ñandú@a.org": (["name@", "exämple", "ñandú"], "email"),
        "Mr. John Smith came. John Smith, or Smith, met Mrs. Smith. Smithson did not.": ([" John", "Smith ", "Smith,", "Smith."], "name"), "GB82 WEST 1234 5698 7654 32": (["WEST", "1234"], "iban"),
    }
    kept = ["AB12 THIS TEXT WITH CAPS HERE", "GB12 WEST 1234 5698 7654 32", "at 12:30:45, std::vector, a::b", "7755680307517467 0123 1234567890123", "Dr. said so", "doctor smith Mr brown", "Smith alone", None, ""]
    got = replaced(spark, [*gone, *kept])
    for i, (before, (words, kind)) in enumerate(gone.items()):
        assert got[i].entity_types == kind, before
        assert all(w not in got[i].text for w in words), (before, got[i].text)
    for i, before in enumerate(kept, len(gone)):
        assert got[i].text == before and got[i].n_entities == 0 and got[i].entity_types == "", (before, got[i].text)
    names = list(gone).index("Mr. John Smith came. John Smith, or Smith, met Mrs. Smith. Smithson did not.")
    first, second, third, fourth = re.fullmatch(r"Mr\. (\w+o \w+) came\. (\w+o \w+), or (\w+), met Mrs\. (\w+)\. Smithson did not\.", got[names].text).groups()
    assert first == second and first.split()[1] == third == fourth
    assert re.fullmatch(r"Mr\. [A-Z]+ left", got[3].text)
    assert mod97(re.search(r"DE[\d ]+\d", got[2].text)[0]) == 1 and mod97(got[9].text) == 1 and re.fullmatch(r"GB\d\d [A-Z]{4}( \d{4}){3} \d\d", got[9].text)
    assert re.search(r"ring 0\d{10} or [2-9]\d\d-[2-9]\d\d-\d{4}", got[5].text)


def test_surrogates_stay_valid(spark):
    rng = random.Random(12)
    phones = [f"+1 ({rng.randrange(200, 1000)}) 555-{rng.randrange(10**4):04}" for _ in range(60)]
    ips = [f"{rng.randrange(1, 256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(60)]
    cards = [c for c in (f"4{rng.randrange(10**15):015}" for _ in range(600)) if luhn(c) == 0][:40]
    got = replaced(spark, [" ; ".join([*phones, *ips, *cards])])[0]
    assert got.n_entities == 120 + len(cards)
    out = got.text.split(" ; ")
    assert all(re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", p) for p in out[:60]) and len({*out}) == len({*phones, *ips, *cards})
    assert all(luhn(c) == 0 and c[0] == "4" for c in out[120:]) and not {*out} & {*phones, *ips, *cards}


def test_colliding_surrogates_are_salted(spark, monkeypatch):
    """With letters for eight surnames only, most of forty collide at first."""
    monkeypatch.setattr(surrogates, "LETTERS", {k: ("b", "ae") for k in surrogates.LETTERS})
    rng = random.Random(2)
    names = sorted({"".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(3)).capitalize() for _ in range(40)})
    df = spark.createDataFrame([(1, "; ".join(f"Mr. {n}" for n in names)), (2, f"Mrs. {names[3]} and {names[3]}")], "i int, text string")
    assert surrogates.collisions(df, "k").count() > len(names) // 2
    got = {r.i: r.text for r in surrogates.replace_entities(df, "k").collect()}
    new = re.findall(r"Mr\. (\w+)", got[1])
    assert len(set(new)) == len(names) and not set(new) & set(names) and got[2] == f"Mrs. {new[3]} and {new[3]}"


def test_long_texts_keep_all_but_the_entities(spark):
    filler = "plain words here. " * 5_000
    got = replaced(spark, [filler + "call 555-123-4567 " + filler + "Ms. Vera Kowalski wrote. " + filler + "Kowalski"])[0]
    assert got.n_entities == 3 and got.text.startswith(filler + "call ") and "Kowalski" not in got.text and "555-123" not in got.text
    assert len(got.text) > 3 * len(filler)
