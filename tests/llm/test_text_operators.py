"""The text operators against brute force, and their edge cases."""

import base64
import collections
import gzip
import hashlib
import html
import re
import zlib

import numpy as np
import pytest
import xxhash
from paperloom.llm import archives, decontaminate, langmix, linededup, maintext, mixing, neighbours, shards, simhash, toxicity
from paperloom.llm.common import table
from paperloom.llm.components import components
from paperloom.llm.queries import QUERIES

LONG = "word " * 30
DOCS = "doc_id long, text string, lang string, source string, n_chars long, taken string, dropped string"
ODD = [
    (1, None, "en", "a", None, None, None),
    (2, "", "en", "a", 0, "x", None),
    (3, "A short line", None, None, 12, "x", "y"),
    (3, "A short line", None, None, 12, "x", "y"),
    (4, "\n\n \n" + LONG + "\n" + LONG.upper(), "en", "a", 1, "x", "y"),
    (None, LONG, "en", "b", 1, "x", "y"),
    *[(i, LONG + "\nown line " + str(i), "en", "b", 1, "x", "y") for i in range(10, 16)],
    (20, "x" * 300000 + " " + LONG * 50, "fr", None, 1, None, None),
]


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return len((text or "").encode().split())


# near copies


def slow_fingerprint(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i : i + 4]), 42) for i in range(max(1, len(found) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """{doc_id: smallest id reached} by comparing all pairs."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(docs):
    prints = {r["doc_id"]: slow_fingerprint(r["text"]) for r in rows(docs)}
    want = slow_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(simhash.near_duplicates(docs))}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_simhash_links_chains_and_dense_groups(spark):
    draws = np.random.default_rng(3)
    base = int(draws.integers(0, 1 << 63))
    prints = {0: base}
    for i in range(1, 40):  # a chain: neighbours differ in four bits
        prints[i] = prints[i - 1] ^ sum(1 << int(b) for b in draws.choice(64, 4, replace=False))
    middle = int(draws.integers(0, 1 << 63))
    for i in range(100, 500):  # a dense group around one fingerprint
        prints[i] = middle ^ sum(1 << int(b) for b in draws.choice(64, 2, replace=False))
    for i in range(1000, 1300):
        prints[i] = int(draws.integers(0, 1 << 63))
    prints[2000] = (1 << 64) - 1  # all segments full
    signed = [(int(np.uint64(f).astype(np.int64)), i) for i, f in prints.items()]
    classes = spark.createDataFrame(signed, "fp long, rep long").groupBy("fp").agg({"rep": "min"}).withColumnRenamed("min(rep)", "rep")
    roots = {r["node"]: r["root"] for r in rows(components(simhash.links(classes)))}
    want = slow_components(prints)
    assert {i: roots.get(i, i) for i in {r["rep"] for r in rows(classes)}} == {r["rep"]: want[r["rep"]] for r in rows(classes)}


def test_simhash_splits_large_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    test_simhash_links_chains_and_dense_groups(spark)


def test_popcount_bound_never_exceeds_the_distance():
    draws = np.random.default_rng(1)
    a = draws.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << draws.integers(0, 64, 2000).astype(np.uint64)) ^ (np.uint64(1) << draws.integers(0, 64, 2000).astype(np.uint64))
    assert simhash._near(a, b).all()
    assert not simhash._near(a[:-1], a[1:]).any()


def test_simhash_odd_rows(odd, none):
    got = rows(simhash.near_duplicates(odd))
    assert len(got) == len(ODD)
    by_id = collections.defaultdict(set)
    for r in got:
        by_id[r["doc_id"]].add((r["fingerprint"], r["component_id"]))
    assert by_id[1] == by_id[2] == {("0" * 16, 1)}
    assert len(by_id[3]) == 1
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in rows(kept) if r["doc_id"] in (1, 2, 3)) == [1, 3, 3]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in rows(components(edges))}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


# lines


def slow_lines(pairs):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    holders = collections.defaultdict(list)
    for number, text in pairs:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(-1 if number is None else number)
    out = []
    for number, text in pairs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 5 or max(holders[key(x)]) == (-1 if number is None else number)]
        out.append((number, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_line_dedup_equals_brute_force(which, request):
    df = request.getfixturevalue(which)
    pairs = [(r["doc_id"], r["text"]) for r in rows(df)]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in rows(linededup.dedup_lines(df))]
    assert sorted(got, key=repr) == slow_lines(pairs)


def test_line_dedup_in_several_passes(odd, none, monkeypatch):
    monkeypatch.setattr(linededup, "PASS_BYTES", 1)
    monkeypatch.setattr(linededup, "SHARD_KEYS", 1)
    test_line_dedup_equals_brute_force_on(odd)
    assert linededup.dedup_lines(none).count() == 0


def test_line_dedup_equals_brute_force_on(odd):
    pairs = [(r["doc_id"], r["text"]) for r in rows(odd)]
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in rows(linededup.dedup_lines(odd))]
    assert sorted(got, key=repr) == slow_lines(pairs)


def test_minimal_perfect_hash():
    draws = np.random.default_rng(5)
    keys = draws.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)
    built = linededup.Shard.build(keys, np.arange(5000), np.arange(5000) * 2)
    again = linededup.Shard.unpack(built.pack())
    at = again.find(keys)
    assert sorted(at.tolist()) == list(range(5000))
    assert (again.counts[at] == np.arange(5000)).all() and (again.keepers[at] == np.arange(5000) * 2).all()
    assert (again.find(draws.integers(0, 1 << 63, (5000, 2), dtype=np.uint64)) == -1).all()


# shards


def test_shards_are_near_equal_and_gapless(docs):
    got = rows(shards.shard(docs))
    want = {r["doc_id"]: (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows(docs)}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == want
    total, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    largest = max(s for s, _ in want.values())
    assert set(total) <= set(range(16))
    assert max(total.values()) - sum(total.values()) / 16 <= largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows(spark, odd, none):
    got = rows(shards.shard(odd, 3))
    assert len(got) == len(ODD) and {r["size"] for r in got if r["doc_id"] == 1} == {1}
    assert shards.shard(none).count() == 0
    same = spark.createDataFrame([(i, "copy") for i in range(1000)], "doc_id long, text string")
    assert set(collections.Counter(r["shard"] for r in rows(shards.shard(same, 4))).values()) == {250}


# mix


def slow_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, room = {}, 1.5 * sum(sizes.values())
    left = set(order)
    while True:
        total = sum(weight[s] for s in left)
        over = {s for s in left if total and room * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not over:
            return target | {s: room * weight[s] / total if total else 0.0 for s in left}
        for s in over:
            target[s] = 2.0 * sizes[s]
        room -= sum(target[s] for s in over)
        left -= over


def test_mix_meets_its_targets(docs):
    got = rows(mixing.mix(docs))
    size = {r["doc_id"]: words(r["text"]) for r in rows(docs)}
    per = collections.Counter()
    for r in rows(docs):
        per[r["source"]] += size[r["doc_id"]]
    want, taken = slow_targets(per), collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in want:
        assert abs(taken[s] - want[s]) <= max(0.1 * want[s], 50)
    again = {r["doc_id"]: r["taken"] for r in rows(mixing.mix(docs))}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_mix_in_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 5)
    test_mix_meets_its_targets(docs)


def test_mix_of_odd_rows(odd, none):
    got = rows(mixing.mix(odd))
    assert len(got) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(none).count() == 0
    mixed = mixing.apply_mix(odd)
    assert mixed.columns == odd.columns
    assert sum(words(r["text"]) for r in rows(mixed)) == sum(r["taken"] for r in got)


def test_flight_keeps_both_sums():
    draws = np.random.default_rng(2)
    chance, size = draws.random(500), draws.integers(1, 1000, 500).astype(float)
    flown = mixing.fly(chance, size, np.random.default_rng(1))
    assert ((flown > 0) & (flown < 1)).sum() <= 2
    assert flown.sum() == pytest.approx(chance.sum(), abs=1e-4)
    assert flown @ size == pytest.approx(chance @ size, rel=1e-6)
    mean = np.mean([mixing.fly(np.full(6, 0.3), np.arange(1.0, 7.0), np.random.default_rng(i)) for i in range(3000)], axis=0)
    assert mean == pytest.approx(np.full(6, 0.3), abs=0.05)


# archives


def test_pages_survive_both_archive_formats(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r["page_id"]: r for r in rows(archives.convert_pages(pages))}
    for r in rows(pages):
        data = (r["html"] or "").encode()
        assert got[r["page_id"]]["payload_bytes"] == len(data)
        assert got[r["page_id"]]["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archives_of_odd_pages(spark):
    pages = [(1, "http://a b/c", "same\r\n\r\nWARC/1.1 text\n"), (2, None, "same\r\n\r\nWARC/1.1 text\n"), (3, "dns:x", None), (5, "http://x", ""), (None, "http://y", "é" * 9), (9, "ftp", "same\r\n\r\nWARC/1.1 text\n"), (9, "http://z", "z")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, payload_digest int")
    got = sorted(((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in rows(archives.convert_pages(df))), key=repr)
    assert (1, "revisit", 9) in got and (2, "revisit", 9) in got and (5, "response", None) in got and (0, "response", None) in got
    assert archives.convert_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("version", ["1", "2"])
def test_arc_is_cut_by_declared_length(version):
    blocks = [b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhttp://x 1.1.1.1 20010101000000 text/html 3\nabc\n", b"", b"\n\n"]
    data = archives.arc_header(version, "f.arc", "20010203040506") + b"".join(archives.arc_record(version, f"http://h/{i} x", "20010203", "text/html", b) for i, b in enumerate(blocks))
    first, *found = archives.read_arc(data)
    assert first["url"] == "filedesc://f.arc"
    assert [(r["url"], r["block"]) for r in found] == [(f"http://h/{i} x", b) for i, b in enumerate(blocks)]
    assert archives.warc_date(found[0]["date"]) == "2001-02-03T00:00:00Z"
    with pytest.raises(ValueError):
        list(archives.read_arc(data[:-2]))
    with pytest.raises(ValueError):
        list(archives.read_arc(data.replace(b"\n" + version.encode(), b"\n7", 1)))


def test_warc_is_cut_by_declared_length():
    made = archives.warc_record("response", "http://a/ b", "2001-01-01T00:00:00Z", "<urn:uuid:1>", b"x\r\n\r\ny", "D") + b"\r\n\r\n"
    for data in (made * 3, gzip.compress(made * 3)):
        found = list(archives.read_warc(data))
        assert [b for _, b in found] == [b"x\r\n\r\ny"] * 3 and found[0][0]["warc-target-uri"] == "http://a/%20b"
    with pytest.raises(ValueError):
        list(archives.read_warc(made[:-5]))


# benchmark items


def slow_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    draws = np.random.default_rng(4)
    for _ in range(300):
        pattern = "".join(draws.choice(list("abc"), int(draws.integers(1, 90))))
        text = "".join(draws.choice(list("abc"), int(draws.integers(0, 120))))
        assert decontaminate.least_distance(pattern, text) == slow_distance(pattern, text)


def test_matcher_finds_all_within_budget():
    draws = np.random.default_rng(6)
    letters = list("abcdefgh ")
    item = decontaminate.normal("".join(draws.choice(letters, 120)))
    matcher = decontaminate.Matcher([(7, item)], 0.08)
    budget = int(len(item) * 0.08)
    for _ in range(200):
        copy = list(item)
        for _ in range(int(draws.integers(0, budget + 4))):
            at = int(draws.integers(0, len(copy)))
            copy[at : at + int(draws.integers(0, 2))] = draws.choice(letters, int(draws.integers(0, 2))).tolist()
        text = "".join(draws.choice(letters, 200)) + "".join(copy) + "".join(draws.choice(letters, 200))
        want = slow_distance(item, text)
        assert matcher.find(text) == ({7: want} if want <= budget else {})


def test_matches_hold_every_exact_passage(spark, sf, docs):
    items = table(spark, sf, "benchmark")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in rows(decontaminate.edit_matches(docs, items))}
    texts = {r["doc_id"]: decontaminate.normal(r["text"]) for r in rows(docs)}
    whole = {r["item_id"]: decontaminate.normal(r["text"]) for r in rows(items)}
    for i, text in texts.items():
        for item, passage in whole.items():
            near = slow_distance(passage, text) if (i, item) in got else None
            assert (passage in text) == (got.get((i, item)) == 0)
            assert near is None or near == got[i, item] <= int(len(passage) * decontaminate.ERROR_RATE)


def test_matches_of_odd_rows(spark, odd, none, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_CHARS", 10)
    items = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "!!", 0), (4, "a SHORT\tline", 0), (4, "word word word", 0)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in rows(decontaminate.edit_matches(odd, items))}
    assert (3, 4, 0) in got and (None, 4, 0) in got and not {g for g in got if g[1] != 4}
    assert decontaminate.edit_matches(none, items).count() == 0
    assert decontaminate.edit_matches(odd, items.limit(0)).count() == 0
    assert decontaminate.keep_clean(odd, items).columns == odd.columns


# language


def test_languages_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r["doc_id"]: r["lang"] for r in rows(docs)}
    got = rows(langmix.language_mixture(docs))
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixture_of_two_languages(spark):
    docs = rows(table(spark, "/root/testdata/sf0.01", "documents").where("length(text) > 400"))
    model = langmix.train(table(spark, "/root/testdata/sf0.01", "documents"))
    one = {x: next(r["text"][:4000] for r in docs if r["lang"] == x) for x in ("en", "fr")}
    share, size = langmix.infer(model, [one["en"], one["en"][:400] + " " + one["fr"][:400], "12 34", None])
    en, fr = model.languages.index("en"), model.languages.index("fr")
    assert size[0] == 1 and share[0, en] == 1
    assert size[1] == 2 and 0.3 < share[1, en] < 0.7 and share[1, en] + share[1, fr] == pytest.approx(1, abs=0.05)
    assert size[2] == size[3] == 0


def test_chunks_cut_long_texts(monkeypatch):
    table_ = langmix.letter_table()
    text = "abc déf. " * 200
    whole = [np.concatenate([c for c, _, _ in langmix.chunks([text], table_)]), sum(len(s) for _, s, _ in langmix.chunks([text], table_))]
    monkeypatch.setattr(langmix, "CHUNK", 50)
    assert (np.concatenate([c for c, _, _ in langmix.chunks([text], table_)]) == whole[0]).all()
    assert sum(len(s) for _, s, _ in langmix.chunks([text], table_)) == whole[1] == 400


def test_languages_of_odd_rows(odd, none):
    got = rows(langmix.language_mixture(odd))
    assert len(got) == len(ODD)
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (1, 2)} == {("und", 0.0)}
    assert langmix.language_mixture(none).count() == 0


# main text


def test_main_text_is_the_article(spark, sf):
    pages = table(spark, sf, "pages")
    got = {r["page_id"]: r for r in rows(maintext.extract(pages))}
    for r in rows(pages):
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
        assert got[r["page_id"]]["text"] == " ".join(html.unescape(inner).split())
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


PAGES = [
    ("<body><nav>a b</nav><div id=content><p>One <b>t</b>wo&nbsp;three</p><p>four</div><footer>x y z</footer>", "One two three four"),
    ("<article><header><h1>Head</h1><p>by me</p></header><p>Body<aside>side words</aside> text</p><div class='ad-box ad'>buy buy</div><p>End<footer>tags</footer></article><section class=comments><p>I say a lot of things</p></section>", "Head Body text End"),
    ("<main><p>A &lt;tag&gt; &amp; more</p><form>search me<input></form><article class=comment>me too</article></main>", "A <tag> & more"),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style><p>yes<!-- <p>no</p> --></p>", "yes"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one two a b"),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text_of_odd_pages(page, want):
    assert maintext.main_text(page, maintext.Weights()) == want


def test_best_run_is_the_maximum():
    draws = np.random.default_rng(8)
    for _ in range(200):
        values = draws.integers(-5, 5, int(draws.integers(0, 12))).astype(float)
        a, b = maintext.best_run(values)
        sums = [values[i:j].sum() for i in range(len(values)) for j in range(i, len(values) + 1)]
        assert values[a:b].sum() == max([0, *sums])


def test_main_text_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, 1), (1, None, "<p>x", 1), (None, "u", "<p>x</art", 1)], "page_id long, url string, html string, text int")
    assert sorted(r["text"] for r in rows(maintext.extract(df))) == ["", "x", "x"]
    assert maintext.extract(df.limit(0)).count() == 0


# neighbours


def test_search_finds_the_neighbours(spark):
    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in rows(df)}
    got = collections.defaultdict(list)
    for r in rows(neighbours.search(df)):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids = np.array(sorted(data))
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = np.array([data[i] @ data[q] if i != q else -np.inf for i in ids])
        hits += len(set(ids[np.lexsort((ids, -score))[:20]]) & {v for _, v, _ in got[q]})
        total += 20
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(s == pytest.approx(float(data[v] @ data[q]), abs=1e-12) for _, v, s in found)
    assert hits / total >= 0.9


def test_search_of_odd_rows(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.0]), (9, [-1.0, 0.0])]
    df = spark.createDataFrame([(*d, 0) for d in data], "vec_id long, embedding array<float>, rank int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(neighbours.search(df)))
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 20, 1.0), (0, 4, 9, -1.0), (20, 1, 0, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 1.0), (20, 4, 9, -1.0)]
    assert neighbours.search(df.limit(0)).count() == 0


def test_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    test_search_finds_the_neighbours(spark)


# toxicity


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    toxic = {r["doc_id"]: r["toxic"] for r in rows(labels)}
    got = rows(toxicity.toxicity(docs, labels))
    held = [r for r in got if r["held_out"] and r["doc_id"] in toxic]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)
    hit = [r["predicted"] for r in held if toxic[r["doc_id"]] == 1]
    wrong = [r["predicted"] for r in held if toxic[r["doc_id"]] == 0]
    assert np.mean(hit) > 0.88 and np.mean(wrong) < 0.01


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(10, 1), (10, 0), (11, None), (None, 1), (12, 0)], "doc_id long, toxic int")
    got = rows(toxicity.toxicity(odd, labels))
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(odd, labels.limit(0)).count() == len(ODD)
    assert toxicity.keep_clean(odd, labels).columns == odd.columns


def test_risk_is_bounded_below():
    draws = np.random.default_rng(9)

    def sample(n, toxic):
        return [(np.unique(np.append(draws.integers(0, 400, 30), 500 if toxic else 600)), None) for _ in range(n)]

    fill = [(c, np.ones(len(c))) for c, _ in sample(200, True)]
    mixed = [(c, np.ones(len(c))) for c, _ in sample(100, True) + sample(900, False)]
    kept, weights, bias = toxicity.fit(fill, mixed, 0.1)
    named = dict(zip(kept.tolist(), weights.tolist()))
    assert named[500] > 2 and bias < 0


# all queries


def test_queries_return_their_contract(spark, sf):
    want = {
        "op1_language_mixture": ("doc_id", "held_out", "lang_pred", "score"),
        "op2_main_text": ("page_id", "url", "text", "n_chars"),
        "op3_arc_to_warc": ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"),
        "op4_edit_matches": ("doc_id", "item_id", "distance"),
        "op5_simhash_components": ("doc_id", "fingerprint", "component_id"),
        "op6_cube_mix": ("doc_id", "size", "source_size", "target", "taken"),
        "op7_learned_partitions": ("query_id", "rank", "vec_id", "score"),
        "op8_byte_shards": ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"),
        "op9_line_dedup": ("doc_id", "n_lines", "n_dropped", "kept_sha256"),
        "op10_pu_toxicity": ("doc_id", "held_out", "score", "predicted"),
    }
    for name, columns in want.items():
        assert tuple(QUERIES[name](spark, sf).columns[: len(columns)]) == columns
