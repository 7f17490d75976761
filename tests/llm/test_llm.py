import base64
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwerk.llm import components, fusion, leaks, plain, tokens, toxicity, variants


def uid(n):
    h = f"{n:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def test_consolidate(spark):
    random.seed(3)
    links = [(1, [2, 3]), (2, [4]), (7, []), (8, None), (5, [5]), (1, [2, 3])] + [(100 + i, [101 + i]) for i in range(60)] + [(1000, list(range(2000, 2300)))]  # a chain and a star
    links += [(random.randrange(3000, 3200), [random.randrange(3000, 3200)]) for _ in range(90)]
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, bs in links:
        find(a)
        for b in bs or []:
            p[max(find(a), find(b))] = min(find(a), find(b))
    rows = [(uid(a).upper() if a == 2 else uid(a), None if bs is None else [f" {{{uid(b)}}} " if b == 4 else uid(b).replace("-", "") for b in bs], "x") for a, bs in links]
    rows += [(uid(8), ["unknown", "", None, "null", uid(0)], "x"), (uid(9), ["unknown", uid(0)], "x"), (None, [uid(7)], "x"), ("nonsense", ["nonsense"], "x")]
    p.setdefault(9, 9)
    df = spark.createDataFrame(rows, "uuid string, source_uuids array<string>, root string")  # a column named like an inner one
    got = {r.uuid: r.group_uuid for r in components.consolidate(df).collect()}
    assert got == {uid(x): uid(find(x)) for x in list(p)}
    assert components.consolidate(df.limit(0)).count() == 0


R = "uuid:string,source:string,collected_at:string,website_url:string,headquarters_location:string,jurisdiction:string,revenue_usd:bigint,employees:bigint,founded_year:bigint,ceo:string"


def test_choose(spark):
    rec = lambda u, s, at, ceo=None, rev=None, web=None: (u, s, at, web, None, "XX", rev, 0, 9999, ceo)
    originals = [
        rec("a", "Best", "2020-01-01", "N/A", 5, "http://"), rec("b", "Mid", "1700000000", "Bea", 999999999999, "www.b.example"), rec("c", "Mid", "Tue, 14 Nov 2023 22:13:21 GMT", "Cee", -1), rec("d", None, None, "Dee"),
        rec("e", "Mid", "2023-11-14T23:13:21+01:00", "Eee"), rec("c", "Mid", "Tue, 14 Nov 2023 22:13:21 GMT", "Cee", -1), None,
    ]
    schema = f"block_id bigint, extra string, original_companies array<struct<{R}>>, resolved_companies array<struct<uuid:string,source_uuids:array<string>>>"
    rows = [(1, "x", originals, [("g", ["a", "b", "c", "d", "e", "zz"]), ("one", ["a", "zz"]), ("none", None), None, ("fill", ["a", "a", "c"])]), (2, None, None, [("x", ["a", "b"])]), (3, None, [], []), (4, None, originals, None)]
    b = spark.createDataFrame(rows, schema)
    s = spark.createDataFrame([("Best", 1), ("Mid", 2), (None, 0)], "name string, trust_rank bigint")
    got = {(r.group_uuid, r.field_name): r.source_uuid for r in fusion.choose(b, s).collect()}
    # c and e are of one moment: the smaller uuid
    assert got == {("g", "ceo"): "c", ("g", "revenue_usd"): "a", ("g", "website_url"): "b", ("fill", "ceo"): "c", ("fill", "revenue_usd"): "a"}
    assert fusion.choose(b.limit(0), s).count() == 0
    f = {r.group_uuid: r for r in fusion.fuse(b, s).collect()}
    assert f["g"].revenue_usd == 5 and f["g"].website_url == "www.b.example" and f["g"].ceo in {"Bea", "Cee", "Dee", "Eee"}
    assert fusion.fuse(b.limit(0), s).count() == 0


def test_fusion_finds_truth_and_copies(spark):
    random.seed(1)
    blocks, truth = [], {}
    for g in range(250):
        true, false = f"T{g}", [f"F{g}{k}" for k in range(20)]
        truth[f"g{g}"] = true
        bad = random.choice(false) if random.random() < 0.5 else true
        claim = {"good1": true if random.random() < 0.9 else random.choice(false), "good2": true if random.random() < 0.9 else random.choice(false), "good3": true if random.random() < 0.9 else random.choice(false), "orig": bad, "copy1": bad, "copy2": bad}
        blocks.append((g, [(f"{g}-{s}", s, None, None, None, None, None, None, None, v) for s, v in claim.items()], [(f"g{g}", [f"{g}-{s}" for s in claim])]))
    b = spark.createDataFrame(blocks, f"block_id bigint, original_companies array<struct<{R}>>, resolved_companies array<struct<uuid:string,source_uuids:array<string>>>")
    right = sum(r.ceo == truth[r.group_uuid] for r in fusion.fuse(b).collect())
    assert right > 235  # a vote would lose every group in which the copies agree on a false value with three votes to fewer
    s = {r.source: r for r in fusion.source_accuracy(b).collect()}
    assert s["copy1"].copies_from in {"orig", "copy2"} and s["good1"].copies_from is None and s["good1"].accuracy > s["copy1"].accuracy


def test_variants_leave_the_driver_room(spark, monkeypatch):
    """The long join of p5 begins with edges, cores and initials alone on disk and the driver's garbage collected; frontiers are broadcast up to 20,000 ids."""
    seen, cuts, near, comps = [], [], variants.near_cores, variants.components

    class Cut(variants.Cut):
        def __init__(self, *a):
            super().__init__(*a)
            cuts.append(self)

        def sweep(self, *tables):
            seen.append("sweep")
            super().sweep(*tables)

    monkeypatch.setattr(variants, "Cut", Cut)
    monkeypatch.setattr(variants, "near_cores", lambda c: seen.append(sum(bool(p) for p, _ in cuts[0].made.values())) or near(c))
    monkeypatch.setattr(variants, "components", lambda e, cut, ids=200_000: seen.append(ids) or comps(e, cut, ids))
    rows = [("a", "Melon Barrow Foods Ltd"), ("b", "Mellon Barrow"), ("c", "M. Barrow"), ("d", "Quentin Vale"), ("d", "Quentin Vale"), (None, "Quentin Vale")]
    df = spark.createDataFrame([(u, n, *[None] * 5) for u, n in rows], "uuid string, name string, description string, cik string, website_url string, linkedin_url string, headquarters_location string")
    groups = {}
    for r in variants.group_variants(df).collect():
        groups.setdefault(bytes(r["group"]), []).append(r["uuid"])
    assert sorted(sorted(g) for g in groups.values()) == [["a", "b", "c"], ["d"]]
    assert [x for x in seen if x != "sweep"] == [3, 20_000] and seen.index(3) > seen.index("sweep")
    # the joins by shuffle give what the broadcasts give
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)], "a bigint, b bigint")
    assert {tuple(r) for r in comps(edges, None, 0).collect()} == {tuple(r) for r in comps(edges).collect()}


def test_name_keys_and_variants(spark):
    cols = "uuid string, name string, description string, cik string, website_url string, linkedin_url string, headquarters_location string, group string"
    row = lambda u, n, d=None, c=None, w=None, l=None, h=None: (u, n, d, c, w, l, h, "x")
    rows = [
        row("a1", "Kelinix Tadirulal Engineering Co"), row("a2", "KELINIX  TADIRULAL ENGRG CO."), row("a3", "Kelinx Tadriulal"), row("a4", "Kélinix Tadîrulal (KT)"), row("a5", "Engineering, Tadirulal Kelinix"), row("a6", "KelinixTadirulal"), row("a7", None, "Kelinix Tadirulal plans rail tunnels from Halvik."),
        row("a8", "KTE", "Maker of Depidofinogosi, based in Halvik; registered as Kelinix Tadirulal."), row("a9", "K. Tadirulal Eng."), row("a10", "Kelin", "Vendor of the Depidofinogosi family; plans rail."), row("a11", "KT", None, None, "http://www.tadirulalkelinix.example/about"), row("a1", "Kelinix Tadirulal Engineering Co"),
        row("b1", "Kelinix Bamosugar Foods Ltd"), row("b2", "KTE"), row("b3", "Kelinix Tadirulak Mining", None, "0001234567"), row("b4", "Kelinix Tadirulak Mining", None, "0007654321"), row("b5", ""), row("b6", None), row(None, "Kelinix Tadirulal"), row("b7", "x" * 5000),
    ]
    df = spark.createDataFrame(rows, cols)
    pairs = {tuple(r) for r in variants.variant_pairs(df).collect()}
    a = sorted(f"a{i}" for i in range(1, 12))
    want = {(x, y) for x in a for y in a if x < y}
    assert want <= pairs, want - pairs
    assert not {p for p in pairs - want if {"b1", "b2", "b5", "b6", "b7"} & set(p)}
    assert not any(p[0].startswith("a") != p[1].startswith("a") for p in pairs), "a trade or number that differs keeps names apart"
    assert variants.variant_pairs(df.limit(0)).count() == 0


def test_ordinary_names_alone(spark):
    one = [
        ("Siemens AG", "Simens AG"), ("Nokia Corporation", "Nokia Corp"), ("International Business Machines", "Internationl Business Machines Corp."), ("Bank of New York Mellon", "Bank of New York Melon"), ("3M Company", "3M Co"), ("Robert Smith Holdings", "Bob Smith Holdings"),
        ("Volkswagen AG", "Volkswagon"), ("Toyota Motor Corporation", "Motor Toyota Corp."), ("JPMorgan Chase & Co.", "JPMorgan Chase"), ("Johnson & Johnson", "Jonhson and Johnson"), ("Procter & Gamble Co", "Procter and Gamble"), ("Lockheed Martin Corp", "Lockhead Martin"), ("Koninklijke Philips N.V.", "Koninklijke Phillips NV"),
        ("Nestlé S.A.", "NESTLE SA"), ("Berkshire Hathaway Inc", "Hathaway Berkshire"), ("Hewlett-Packard Company", "Hewlett Packard"), ("Mitsubishi Heavy Industries", "Mitsubishi Heavy Inds."), ("Ernst & Young Global", "Ernst Young Global Ltd"),
    ]
    apart = [("American Express", "American Express Bank"), ("General Electric Company", "General Electric Aviation Ltd"), ("First National Bank", "First National Trust"), ("Deutsche Bank AG", "Deutsche Post AG"), ("United Airlines", "United Technologies"), ("Delta Air Lines", "Delta Dental"), ("Ford Motor", "Ford Foundation")]
    names = sorted({n for p in one + apart for n in p})
    rows = [(n, n, None, None, None, None, None) for n in names]
    got = {tuple(r) for r in variants.variant_pairs(spark.createDataFrame(rows, "uuid string, name string, description string, cik string, website_url string, linkedin_url string, headquarters_location string")).collect()}
    want = {tuple(sorted(p)) for p in one}
    assert len(got & want) >= 0.9 * len(want), want - got
    assert len(got & want) >= 0.9 * len(got) and not got & {tuple(sorted(p)) for p in apart}, got - want


def test_very_long_names(spark):
    long = " ".join(f"word{i}x" for i in range(1500))
    rows = [("a", long), ("b", long.replace("word700x", "wrod700x")), ("c", "q" * 60000), ("d", "q" * 60000 + "r"), ("e", "Word " + "z " * 3000), ("f", None), ("g", "")]
    df = spark.createDataFrame([(u, n, (n or "") * 3, None, None, None, None) for u, n in rows], "uuid string, name string, description string, cik string, website_url string, linkedin_url string, headquarters_location string")
    assert {tuple(r) for r in variants.variant_pairs(df).collect()} == {("a", "b"), ("c", "d")}


def test_longer_words_allow_two_edits(spark):
    random.seed(12)
    names = []
    for i in range(60):
        w = "".join(random.choice("bdfgklmnprst") + random.choice("aeiou") for _ in range(random.randint(3, 8)))
        t = list(w)
        for _ in range(random.choice([0, 1, 2])):
            j = random.randrange(len(t))
            t[j : j + 1] = random.choice([[], [random.choice("xz")], [t[j], random.choice("xz")]])
        names += [(2 * i, [w, "alpha", "beta"]), (2 * i + 1, ["alpha", "".join(t), "beta"] if i % 3 == 0 else ["beta", "".join(t), "alpha"][::-1] if i % 3 == 1 else ["".join(t), "alpha", "beta"])]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    k = lambda n: 0 if n < variants.EDITS[0] else 1 if n < variants.EDITS[1] else 2
    near = lambda a, b: distance(a, b) <= k(min(len(a), len(b)))
    orders = lambda w: [x[i:] + x[:i] for x in (w, w[::-1]) for i in range(len(w))]
    want = {(i, j) for i, a in names for j, b in names if i < j and any(all(map(near, a, o)) for o in orders(b))}
    got = {tuple(r) for r in variants.near_cores(spark.createDataFrame(names, "core bigint, w array<string>")).collect()}
    assert want <= got and len(got - want) <= 2


def test_segment_join_against_brute_force(spark):
    random.seed(2)
    syl = [c + v for c in "bdfgklmnprst" for v in "aeiou"]
    word = lambda: "".join(random.choice(syl) for _ in range(3)) + random.choice(["", "x", "nt", "s"])

    def typo(w):
        i = random.randrange(len(w) - 1)
        return random.choice([w[:i] + w[i + 1 :], w[:i] + random.choice("aeioubkl") + w[i:], w[:i] + random.choice("aeioubkl") + w[i + 1 :], w[:i] + w[i + 1] + w[i] + w[i + 2 :]])

    base = [(word(), word()) for _ in range(120)]
    names = sorted(set(base + [(typo(a), typo(b)) for a, b in base] + [(typo(b), a) for a, b in base]))

    def near(a, b):
        if a == b:
            return True
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
        s, t = sorted((a, b), key=len)
        return len(t) - len(s) == 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    want = {(i, j) for i, (a, b) in enumerate(names) for j, (c, d) in enumerate(names) if i < j and ((near(a, c) and near(b, d)) or (near(a, d) and near(b, c)))}
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(names)], "core bigint, t1 string, t2 string")
    got = {tuple(r) for r in variants.similar_names(df).collect()}
    assert want <= got and len(got - want) <= 2  # equal letters at distance two may also be a swap of two that aren't neighbours


@pytest.fixture(scope="module")
def vocabulary():
    with open(tokens.default_path(), "rb") as f:
        return tokens.Vocabulary.parse(f.read())


def test_tokens_equal_the_public_encoder(spark, vocabulary):
    import tiktoken

    t = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    e = tokens.Encoder(vocabulary)
    random.seed(4)
    texts = ["".join(random.choice(["a", "aa", "the ", "  ", "\n", "é", "漢", "🙂", "​", "ing", "\xa0", "1", "23", "'s", "!!", "<|endoftext|>", "ab" * 5, "\t", "Ж"]) for _ in range(random.randint(0, 40))) for _ in range(400)] + ["a" * 30000 + "ab" * 3000]
    assert [e.encode(x) for x in texts] == [t.encode_ordinary(x) for x in texts]
    rows = [(i, x, "y") for i, x in enumerate(texts[:50])] + [(900, None, "y"), (901, "", "y"), (902, "  ", "y"), (None, "x", "y"), (900, "dup", "y")]
    got = [(r.doc_id, r.ids) for r in tokens.encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids string")).collect()]
    assert sorted(got, key=str) == sorted([(i, t.encode_ordinary(x or "")) for i, x, _ in rows], key=str)
    assert tokens.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_prefixes_append_and_splice(vocabulary):
    random.seed(6)
    for _ in range(300):
        b = bytes(random.choice(b"abcdehtin gs") for _ in range(random.randint(0, 40)))
        x, i = tokens.Prefixes(vocabulary, b), random.randint(0, len(b))
        j = random.randint(i, len(b))
        new = random.choice([b"", b"xyz", b" the ", b"aaaa"])
        x.splice(i, j, new)
        y = tokens.Prefixes(vocabulary, b[:i] + new + b[j:])
        assert (x.last, x.data) == (y.last, y.data)
        assert tokens.Prefixes(vocabulary, b[:i]).append(b[i:]).ids() == tokens.Prefixes(vocabulary, b).ids()
        assert b"".join(vocabulary.text[t] for t in y.ids()) == y.data


def test_vocabulary_file_is_read(tmp_path):
    lines = b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256))
    v = tokens.Vocabulary.parse(lines + b"\n" + base64.b64encode(b"ab") + b" 256\n")
    assert tokens.Prefixes(v, b"aabb").ids() == [97, 256, 98]


def brute(item, doc):
    for a in range(len(item)):
        for j in (j for j in range(len(doc)) if doc[j] == item[a]):
            m = len(item) - a
            prev = list(range(m + 1))
            for c, w in enumerate(doc[j : j + m + m // 7 + 1], 1):
                cur = [c]
                for i in range(1, m + 1):
                    cur.append(min(prev[i] + 1, cur[i - 1] + 1, prev[i - 1] + (item[a + i - 1] != w)))
                prev = cur
                if any(7 * cur[i] <= i for i in range(20, m + 1) if item[a + i - 1] == w):
                    return True
    return False


def test_leaks(spark):
    random.seed(8)
    words = [f"{c}{v}{d}" for c in "bdfgklm" for v in "aeiou" for d in "nrst"]
    items = [(i, " ".join(random.choice(words) for _ in range(random.choice([15, 30, 60, 80])))) for i in range(12)]
    index = leaks.Index(items)
    assert leaks.least_hits() == leaks.HITS
    docs = []
    for k in range(400):
        i, t = random.choice(items)
        w = t.split()
        n = random.randint(12, min(len(w), 50))
        a = random.randint(0, len(w) - n)
        run = w[a : a + n]
        for _ in range(random.randint(0, n // 5)):
            j = random.randrange(len(run))
            run[j : j + 1] = random.choice([[], ["zzz"], [random.choice(words)]])
        docs.append((k, " ".join([random.choice(words) for _ in range(30)] + run + [random.choice(words) for _ in range(30)])))
    for _, d in docs:
        assert set(index.found(d)) == {i for i, w in index.items.items() if brute(w, plain.words(d))}
    full = [x for x in items if len(x[1].split()) >= 30]
    t = full[0][1]
    dressed = "> " + t.upper().replace("A", "А").replace(" ", "\n> ", 5).replace(" ", " <b>", 1).replace("E", "É", 3)
    rows = [(1, dressed, "s"), (2, None, "s"), (3, "", "s"), (4, " ".join(t.split()[:19]), "s"), (5, t, "s"), (5, t, "s"), (6, "a " * 200000 + t, "s")]
    got = leaks.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string, item_id string"), spark.createDataFrame([*items, (None, t), (99, None), (98, "")], "item_id bigint, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(1, full[0][0]), (5, full[0][0]), (5, full[0][0]), (6, full[0][0])]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.find_leaks(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), none).count() == 0


def test_plain_words():
    assert plain.words("Тhe &amp; Ｆull​width <b>naïve</b> con-\nveyor *x*_y_") == ["the", "fullwidth", "naive", "conveyor", "x", "y"]


def test_toxicity_held_out(spark):
    random.seed(9)
    calm = ["The plant in {} adds pumps.", "Sales of {} rose.", "The {} trade office signed a pact.", "Rats were used in trials of {}.", "Rival {} cut the price."]
    bad = ["You stupid {w}, crawl back.", "Never hire a {g}, they are {w} by blood.", "I will {v} you, {w}.", "{g}s are {w} and must go."]
    ins, grp, verb = ["idiot", "moron", "filth", "vermin", "scum", "parasite"], ["Yurran", "Sabric", "Kelmite"], ["strangle", "kill", "stab"]
    name = lambda: "".join(random.choice(["ba", "ko", "ri", "tu", "se"]) for _ in range(3)).title()
    disguise = lambda s: random.choice([s, s.upper(), s.replace("i", "1"), s.replace("moron", "m o r o n")])

    def doc():
        s = [random.choice(calm).format(random.choice([name(), random.choice(grp) + "ian"])) for _ in range(5)]
        y = int(random.random() < 0.3)
        if y:
            s.insert(random.randrange(5), disguise(random.choice(bad).format(w=random.choice(ins), g=random.choice(grp), v=random.choice(verb))))
        return " ".join(s), y

    data = [doc() for _ in range(900)]
    docs = [(i, t, "ab"[i % 2], "z") for i, (t, _) in enumerate(data)] + [(9000, None, "a", "z"), (9001, "", None, "z"), (9002, " \n ", None, "z"), (9003, "word " * 50000 + "you stupid idiot, crawl back.", "a", "z")]
    labels = [(i, y if random.random() > 0.04 else 1 - y, "r") for i, (_, y) in enumerate(data[:600])] + [(0, None, "r"), (None, 1, "r"), (77777, 1, "r")]
    d, l = spark.createDataFrame(docs, "doc_id bigint, text string, source string, score string"), spark.createDataFrame(labels, "doc_id bigint, toxic bigint, rater string")
    s = {r.doc_id: r.score for r in toxicity.score(d, l).collect()}
    right = sum((s[i] >= 0.5) == bool(data[i][1]) for i in range(600, 900))
    assert right >= 288, right
    assert len(s) == len(docs) and s[9000] == s[9001] == s[9002] == 0.0 and s[9003] >= 0.5
    assert sum(r.documents for r in toxicity.rates(toxicity.score(d, l)).collect()) == len(docs)
    assert toxicity.score(d, l.limit(0)).count() == len(docs) and toxicity.score(d.limit(0), l).count() == 0


def test_pairs_tell_what_terms_alone_do_not():
    rng = np.random.default_rng(3)
    x = np.zeros((4000, toxicity.WINDOW), np.int32)
    a, b = rng.random(4000) < 0.5, rng.random(4000) < 0.5
    x[:, 0], x[:, 1], x[:, 2:6] = a * 1, b * 2, rng.integers(3, 40, (4000, 4))
    y = (a & b | ~a & ~b).astype(np.float32)
    whole, additive = toxicity.Machine(40), toxicity.Machine(40)
    additive.v[:] = 0  # stays 0, as its gradient is a multiple of it
    right = [((m.fit(x[:3000], y[:3000], 12).score(x[3000:]) > 0.5) == (y[3000:] > 0.5)).mean() for m in (whole, additive)]
    assert right[0] > 0.95 and right[1] < 0.7, right


@pytest.mark.skipif(not os.path.exists("/root/testdata/check_l/labels.parquet"), reason="needs the test tables")
def test_toxicity_held_out_labels(spark):
    """Held-out labels of the large check tables: the precision and recall that the README states, wrong labels included."""
    read = lambda n: spark.read.parquet(f"/root/testdata/check_l/{n}.parquet")
    train, rest = [read("labels").where(f"pmod(xxhash64(doc_id, 5), 3) {x}") for x in ("> 0", "= 0")]
    truth = {r.doc_id: r.y > 0.5 for r in rest.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("y")).where("y <> 0.5").collect()}
    docs = read("documents").where("text IS NOT NULL").join(read("labels").select("doc_id").distinct(), "doc_id", "left_semi")
    found = {r.doc_id for r in toxicity.score(docs, train).where("score >= 0.5").collect()} & set(truth)
    hits, all_true = sum(truth[i] for i in found), sum(truth.values())
    print(f"held out: {len(truth)} documents, {all_true} labelled positive, {len(found)} found, {hits} of them labelled positive")
    assert hits / len(found) > 0.93 and hits / all_true > 0.78
