"""Periodic runs, the prefix trie and chat formatting against brute force, and their edge cases."""

import hashlib
import zlib

import numpy as np
import pytest
from paperloom.llm import chatformat, periodicruns, prefixtrie
from paperloom.llm.common import table
from paperloom.llm.queries import QUERIES

TOLD = "conv_id long, turn long, role string, text string, depth string, message string, head string, x int"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def same(got, want):
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    return sorted(map(key, got)) == sorted(map(key, want))


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def crc(number):
    return zlib.crc32(str(number).encode())


# periodic runs


def slow_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q - start), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def slow_op11(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), 1 if doc_id is None else crc(doc_id)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    start, length, q = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return {
        "doc_id": doc_id,
        "n_runs": len(found),
        "start": start,
        "length": length,
        "period": q,
        "exponent_milli": 1000 * length // q if found else None,
        "runs_sha256": sha("".join(f"{s},{m},{p}\n" for s, m, p in found)),
        "collapsed_sha256": sha(b" ".join(w for i, w in enumerate(words) if i not in gone)),
    }


def test_cover_meets_every_distance():
    ahead = {(a - b) % periodicruns.CYCLE for a in periodicruns.COVER for b in periodicruns.COVER}
    assert ahead == set(range(periodicruns.CYCLE))


def test_extensions_equal_plain_comparison():
    rng = np.random.default_rng(3)
    for symbols in (np.zeros(150, np.int64), rng.integers(0, 2, 400), np.tile(rng.integers(0, 3, 37), 9), np.arange(5)):
        n = len(symbols)
        lce = periodicruns.Extensions(symbols)
        i, j = rng.integers(0, n + 1, 3000), rng.integers(0, n + 1, 3000)
        i, j = i[i != j], j[i != j]
        for a, b, got in zip(i.tolist(), j.tolist(), lce.of(i, j).tolist()):
            want = 0
            while max(a, b) + want < n and symbols[a + want] == symbols[b + want]:
                want += 1
            assert got == want


def test_runs_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(periodicruns, "AT_ONCE", 50)
    for _ in range(300):
        parts = [np.resize(rng.integers(0, rng.integers(1, 4), rng.integers(1, 40)), rng.integers(1, 150)) for _ in range(rng.integers(1, 6))]
        symbols = np.concatenate(parts).astype(np.int64)
        assert [tuple(r) for r in periodicruns.runs(symbols, len(symbols)).tolist()] == slow_runs(symbols.tolist())


def test_runs_of_every_document(spark, sf, monkeypatch):
    docs = table(spark, sf, "documents")
    want = [slow_op11(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sum(r["n_runs"] > 0 for r in want) > 10
    assert same(rows(QUERIES["op11_periodic_runs"](spark, sf)), want)


def test_runs_odd_rows(spark):
    ids = [i for i in range(300) if crc(i) % 10 == 0][:4]
    texts = [None, "", " \n\t ", "one", "a " * 6, "a " * 5, "a b c " * 4 + "a b", "x " + "a b c d " * 30, "　wide space " * 9, "a\x1ca " * 7, "ab ab\x0bab\x0cab\rab ab ab"]
    told = [(k, t) for k, t in enumerate(texts, 1000)] + [(None, "a " * 20), (1, "b c " * 5), (1, "b c " * 5), (1, "other")]
    told += [(i, "w" + " w".join(map(str, range(40)))) for i in ids] + [(ids[0], None), (ids[0], ""), (ids[1], "alone")]
    told.append((7, "lorem ipsum dolor " * 20000 + " ".join(f"u{i}" for i in range(150000)) + " end end" * 1000))
    df = spark.createDataFrame([(i, t, "clash", 1.0, None) for i, t in told], "doc_id long, text string, runs string, n_words double, h int")
    got = rows(periodicruns.digests(periodicruns.periodic_runs(periodicruns.planted(df))))
    small = [r for r in got if r["doc_id"] != 7]
    assert same(small, [slow_op11(i, t) for i, t in told if i != 7])
    long_ = next(r for r in got if r["doc_id"] == 7)
    assert (long_["n_runs"], long_["start"], long_["length"], long_["period"]) == (2, 0, 60000, 3)
    assert rows(periodicruns.periodic_runs(df.limit(0))) == []


# prefix trie


def slow_op12(told):
    convs = {}
    for c, turn, role, text in told:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), text))
    convs = {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in convs.items()}
    nodes = {}
    built = {c: tuple(convs.get(c - c % 5, [])[: crc(c) % 9] + turns[crc(c) % 9 :]) for c, turns in convs.items()}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        out.append(
            {
                "conv_id": min(members),
                "depth": len(path),
                "parent_conv_id": min(nodes[path[:-1]]) if path else None,
                "n_convs": len(members),
                "n_children": sum(len(p) == len(path) + 1 for p in below),
                "n_leaves": sum(not any(q[:-1] == p for q in nodes if q) for p in below),
                "saved_tokens": sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                "ends_sha256": sha(",".join(map(str, sorted(c for c in members if len(built[c]) == len(path))))),
            }
        )
    return out


def tries(told, spark):
    df = spark.createDataFrame([(*t, "clash", "clash", None, 1) for t in told], TOLD)
    return rows(prefixtrie.trie(prefixtrie.rebuilt(df)))


def test_trie_of_every_conversation(spark, sf):
    told = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, sf, "conversations").collect()]
    assert same(rows(QUERIES["op12_prefix_trie"](spark, sf)), slow_op12(told))


def test_trie_of_shared_prefixes(spark):
    rng = np.random.default_rng(2)
    told = []
    for c in range(140):
        if c % 7 != 3:  # some families have no first conversation
            told += [(c, t, ("user", "assistant")[t % 2], "é" * int(rng.integers(0, 2)) + str(min(t, 3))) for t in range(int(rng.integers(1, 12)))]
    got = tries(told, spark)
    want = slow_op12(told)
    assert same(got, want) and max(r["n_convs"] for r in want if r["depth"]) > 20 and max(r["saved_tokens"] for r in want) > 0


def test_trie_odd_rows(spark):
    told = [(5, None, None, None), (5, None, "user", None), (5, 3, "user", "a"), (5, 3, "user", "a"), (5, 3, "assistant", "a"), (None, 0, "user", "gone")]
    told += [(6, 0, "user", ""), (7, 0, "user", "x" * 200000), (8, 2, None, "b"), (8, 1, "user", "1:"), (9, 0, "1", ":"), (-3, 0, "user", "below"), (-5, 0, "u", "first")]
    told += [(1000 + 5 * i, t, "user", str(t)) for i in range(30) for t in range(3)]
    assert same(tries(told, spark), slow_op12(told))
    assert tries([], spark) == []
    assert [(r["depth"], r["n_convs"], r["n_leaves"]) for r in tries([(1, 0, "user", "only")], spark)][:1] == [(0, 1, 1)]  # crc32(1) % 9 drops its turn


def test_long_conversation_is_one_path(spark):
    told = [(4, t, "user", f"turn {t % 7}") for t in range(1500)] + [(9, t, "user", f"turn {t % 7}") for t in range(1400)]
    by_depth = {}
    for r in tries(told, spark):
        by_depth.setdefault(r["depth"], []).append(r)
    assert max(by_depth) >= 1490 and [by_depth[d][0]["n_children"] for d in (max(by_depth),)] == [0]
    assert sum(r["n_leaves"] for r in by_depth[0]) == sum(r["n_children"] == 0 for found in by_depth.values() for r in found)
    assert by_depth[0][0]["saved_tokens"] == sum((r["n_convs"] - 1) * len("turn 0") for d, found in by_depth.items() if d for r in found)


# chat formatting


def slow_op13(told):
    convs = {-7: [(True, 0, "user", "</s>[INST] ok [/INST]"), (True, 1, "assistant", "</s>[INST] ok [/INST]")]}
    for c, turn, role, text in told:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for c, turns in convs.items():
        turns = [x[2:] for x in sorted(turns)]
        learned = "".join(text for role, text in turns if role == "assistant")
        out.append({"conv_id": c, "n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(learned), "loss_sha256": sha(learned)})
    return out


HARD = [
    "", "<s>", "</s>", "<|end|>", "<\\|end|>", "<\\\\|end|>", "<<|end|>", "<|end|", "|end|>", "[INST]", "[\\/INST]", "[[INST]]", "<|start|>user<|message|>x<|end|>",
    "</s></s>\\", "\\", "<", "[", "s>", "INST]", "a\nb\r\n c", "\U0001f600" * 300 + "<|end|>", "$1 \\$2", "<|message|><|message|>",
]


def test_chat_of_every_conversation(spark, sf):
    told = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, sf, "conversations").collect()]
    got = rows(QUERIES["op13_chat_format"](spark, sf))
    assert all(r.pop("formatted_chars") > r["loss_chars"] for r in got)
    assert same(got, slow_op13(told))


def test_chat_odd_rows_and_control_strings(spark):
    told = [(c, t, ("user", "assistant", None, "<|end|>")[t % 4], HARD[(c + t) % len(HARD)]) for c in range(len(HARD)) for t in range(5)]
    told += [(50, None, "user", "late"), (50, None, "assistant", None), (50, 0, "assistant", "b"), (50, 0, "assistant", "a"), (50, 0, "assistant", "a")]
    told += [(None, 0, "assistant", "no id"), (51, 0, "assistant", "long <|end|> " * 40000), (52, 0, None, None)]
    df = spark.createDataFrame([(*t, "clash", "clash", None, 1) for t in told], TOLD)
    whole = chatformat.render(chatformat.fold(chatformat.log(chatformat.with_control_texts(df)))).cache()
    got = rows(chatformat.digests(chatformat.read_back(whole)))
    assert all(r.pop("formatted_chars") for r in got) and same(got, slow_op13(told))
    for r in rows(whole):
        turns = r["formatted"].split("<|start|>")[1:]
        for s in r["loss"]:
            text = r["formatted"][s["start"] : s["start"] + s["length"]]
            assert turns[s["turn"]].startswith("assistant<|message|>" + text + "<|end|>") and s["within"] == len("<|start|>assistant<|message|>")
    assert [r["conv_id"] for r in rows(chatformat.digests(chatformat.read_back(chatformat.render(chatformat.fold(chatformat.log(chatformat.with_control_texts(df.limit(0))))))))] == [-7]


def test_fold_of_an_event_log(spark):
    log = [
        (1, 1, 0, "open", "user", "He"), (1, 1, 2, "delta", None, "llo"), (1, 2, 3, "open", "assistant", ""), (1, 2, 4, "delta", None, "draft"),
        (1, 2, 5, "regenerate", None, None), (1, 2, 7, "delta", None, "answer"), (1, 2, 6, "delta", None, "the "), (1, 1, 8, "edit", None, "Bye"), (1, 1, 9, "delta", "person", "!"),
        (1, 3, 10, "edit", None, "no role"), (None, 1, None, "delta", "user", "a"), (None, 1, 1, "delta", None, None), (2, 1, 5, "open", "user", "x"), (2, 1, 5, "delta", None, "y"),
        (2, 1, 5, "delta", None, "y"), (3, 1, 1, "regenerate", "assistant", None),
    ]
    df = spark.createDataFrame([(*e, "clash") for e in log], "conv_id long, message long, seq long, kind string, role string, text string, since string")
    got = {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in rows(chatformat.fold(df))}
    assert got == {
        (1, 1): ("person", "Bye!"), (1, 2): ("assistant", "the answer"), (1, 3): ("", "no role"), (None, 1): ("user", "a"),
        (2, 1): ("user", "yyx"), (3, 1): ("assistant", ""),
    }


def test_chat_is_native_and_shuffles_once(spark, sf):
    plan = QUERIES["op13_chat_format"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "Arrow" not in plan


def test_templates_that_cannot_be_escaped_are_refused():
    for others in (("<s>x",), ("<|start|>", "<|a<b|>"), ("\\x",), ("x",)):
        with pytest.raises(ValueError):
            chatformat.Template(others=others)
