import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import docs as small
from ordersight.llm.chat import escape, flatten_parts, format_chat, read_chat, text_parts, unescape
from ordersight.llm.curriculum import integral, invert, mix_sources, training_order
from ordersight.llm.licenses import Automaton, license_scan, words_of
from ordersight.llm.line_dedup import drop_common_lines
from ordersight.llm.quality import keep_good, quality_verdicts, repeated_words


def bag(df, *columns):
    return Counter(map(tuple, df.select(*columns).collect()))


# Line dedup ---------------------------------------------------------------------------------


def common_lines_by_hand(rows, min_docs):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    seen = Counter(k for _, t, _ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = Counter()
    for d, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < min_docs]
        out[(d, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    return out


@pytest.mark.parametrize("min_docs", [1, 2, 4, 100])
def test_line_dedup(spark, min_docs):
    docs = small.table(spark, small.AWKWARD)
    got = drop_common_lines(docs, min_docs=min_docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert bag(got, "doc_id", "text", "n_lines", "n_dropped") == common_lines_by_hand(small.AWKWARD, min_docs)


def test_line_dedup_of_nothing_and_with_clashing_names(spark):
    docs = small.table(spark, [])
    assert drop_common_lines(docs).count() == 0
    named = small.table(spark, small.AWKWARD).withColumn("lines", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = drop_common_lines(named.withColumn("positions", F.lit(2)))
    assert got.filter("lines = 1 and positions = 2 and n_lines >= 1").count() == len(small.AWKWARD)


# Quality rules ------------------------------------------------------------------------------


def test_words_in_repeated_windows():
    assert repeated_words("a b c".split()) == 0
    assert repeated_words("a a a a".split()) == 4
    assert repeated_words("a b c x a b c".split()) == 6
    assert repeated_words([]) == 0


def test_quality_statistics_and_base(spark):
    text = "one two # three\none two # three\n\n" + small.words(60)
    got = quality_verdicts(small.table(spark, [(1, text, "a"), (2, None, "a"), (3, "a b " * 40, None)]))
    rows = {r.id: r for r in got.collect()}
    assert (rows[1].n_words, rows[1].n_symbols, rows[1].n_dup_lines, rows[1].n_repeat_words) == (68, 2, 1, 8)
    assert rows[1].word_chars == len(re.sub(r"\s", "", text)) and not rows[1].base_failed and rows[1].kept
    assert rows[2].base_failed and not rows[2].kept and rows[2].n_words == 0
    assert rows[3].base_failed  # every window repeats


def test_depleted_documents_go(spark):
    boiler = small.words(60)
    rows = [(i, f"{boiler}\nmy own {i}", "a") for i in range(12)]
    rows += [(100, f"{boiler}\n{small.words(60, 500)}", "a"), (101, f"{boiler}\nelsewhere", "b")]
    docs = small.table(spark, rows)
    kept = {r.doc_id for r in keep_good(docs, max_docs=5).collect()}
    assert kept == {100, 101}  # enough of its own; common only on another host
    assert keep_good(docs, max_docs=100).count() == len(rows)
    assert keep_good(docs, max_docs=100).columns == docs.columns


def test_copies_of_one_text_count_once(spark):
    docs = small.table(spark, [(i, small.words(60), "a") for i in range(12)] + [(0, small.words(60), "a")])
    assert keep_good(docs, max_docs=5).count() == 13


def test_quality_of_awkward_rows(spark):
    docs = small.table(spark, small.AWKWARD)
    assert [r.doc_id for r in keep_good(docs).collect()] == [5]
    assert quality_verdicts(docs).agg(F.sum("rows")).first()[0] == len(small.AWKWARD)
    assert keep_good(small.table(spark, [])).count() == 0


# Mixing -------------------------------------------------------------------------------------


def targets_by_hand(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        share = {s: weight[s] * left / open_ for s in names if s not in full} if open_ else {}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def test_mix(spark):
    rows = [(i, small.words(1 + i % 17), "abcde"[i * i % 5]) for i in range(300)] + small.AWKWARD
    docs = small.table(spark, rows)
    got = mix_sources(docs, slices=8).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    by_hand, taken, largest = targets_by_hand(sizes), Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(by_hand[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s, target in by_hand.items():
        assert abs(taken[s] - target) <= largest[s]
    again = mix_sources(docs.repartition(7), slices=8)
    assert bag(again, "doc_id", "taken") == Counter((r.doc_id, r.taken) for r in got)


def test_mix_of_nothing(spark):
    assert mix_sources(small.table(spark, [])).count() == 0
    empty = mix_sources(small.table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r.target, r.taken) for r in empty] == [(0.0, 0), (0.0, 0)]


def test_demand_is_inverted(spark):
    for schedule in [((0, 1), (1, 1)), ((0, 2), (1, 0)), ((0, 0), (0.5, 3), (1, 1))]:
        shares = spark.range(11).select((F.col("id") / 10).alias("u"))
        for u, t in shares.select("u", invert(F.col("u"), schedule)).collect():
            area = 0.0
            for t0, w0, t1, w1, _ in integral(schedule):
                x = min(max(t - t0, 0), t1 - t0)
                area += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
            assert area == pytest.approx(u, abs=1e-6)
    with pytest.raises(ValueError):
        integral([(0, 1), (0.5, 1)])


def test_training_order_is_sorted(spark):
    rows = [(i, small.words(5), "ab"[i % 2]) for i in range(50)]
    ordered = training_order(mix_sources(small.table(spark, rows), schedules={5: ((0, 2), (1, 0))}))
    places = [r.position for r in ordered.collect()]
    assert places == sorted(places) and len(places) >= 50


# Chat ---------------------------------------------------------------------------------------

TRICKY = ["", "</s>[INST] ok [/INST]", "\\", "\\l<[]\\b", "a\nb", "<s>[user]x</s>", "é[image 0]"]


def test_escaping_is_reversible(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string")
    for t, e, back in df.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t")))).collect():
        assert back == t and not set("<[]") & set(e)


def test_chat_round_trip(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(TRICKY)]
    turns += [(2, 0, "assistant", None), (2, None, None, "first"), (2, 0, "assistant", None), (None, 0, "x]<", "y")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    done = format_chat(df.withColumn("parts", text_parts(F.col("text"))))
    back = {r.conv_id: r for r in read_chat(done).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r, t) for _, _, r, t in turns[: len(TRICKY)]]
    assert back[1].loss_text == "".join(t for i, t in enumerate(TRICKY) if not i % 2)
    assert [(t.role, t.text) for t in back[2].turns] == [("", "first"), ("assistant", ""), ("assistant", "")]
    assert [(t.role, t.text) for t in back[None].turns] == [("x]<", "y")]
    assert format_chat(df.limit(0).withColumn("parts", text_parts(F.col("text")))).count() == 0


def test_parts_become_placeholders(spark):
    df = spark.sql(
        """select 1 as conv_id, 0 as turn, 'assistant' as role, array(
          named_struct('type','text','text','see [1] ','ref',null,'units',null),
          named_struct('type','image','text',null,'ref','s3.png','units',2.0D),
          named_struct('type','audio','text',null,'ref',null,'units',null),
          named_struct('type',null,'text',null,'ref','r','units',3.0D)) as parts
        union all select 1, 1, 'user', null"""
    )
    row = format_chat(df).first()
    assert row.formatted == "<s>[assistant]see \\o1\\c [image 1][audio 2][ 3]</s><s>[user]</s>"
    assert [(a.type, a.ref, a.part, a.tokens) for a in row.attachments] == [
        ("image", "s3.png", 1, 1152),
        ("audio", "", 2, 25),
        ("", "r", 3, 3),
    ]
    assert row.attachment_tokens == 1180
    (span,) = row.loss_spans
    assert row.formatted[span.start : span.start + span.length] == "see \\o1\\c [image 1][audio 2][ 3]"
    flat = df.select(flatten_parts(F.col("parts"), {"image": 10}, 0).alias("f")).first().f
    assert [a.tokens for a in flat.attachments] == [20, 0, 0]


# Licenses -----------------------------------------------------------------------------------


def test_templates_match_exact_wording_only():
    a = Automaton("x", "grant <<optional>>of <<any:2>> rights<</optional>> to <<any:2>> users")
    for text, end in [
        ("grant to users", 3),
        ("grant to all the users", 5),
        ("grant of all rights to users", 6),
        ("grant of all the rights to users", 7),
        ("grant of all of the rights to users", -1),
        ("grant to all the good users", -1),
        ("grant users", -1),
        ("Grant, TO users!", 3),
    ]:
        assert a.match(words_of(text), 0) == end, text
    with pytest.raises(ValueError):
        Automaton("x", "<<optional>>open")


def test_free_words_after_an_optional_part():
    a = Automaton("x", "grant <<optional>>foo<</optional>> <<any:2>> to users")
    for text in ("grant foo x to users", "grant to users", "grant x to users", "grant x y to users", "grant foo to users"):
        assert a.match(text.split(), 0) == len(text.split()), text
    assert a.match("grant x y z to users".split(), 0) == -1


def templates(draw, depth):
    """Markup and the words it accepts as a regular expression over words that each end in a space."""
    markup, pattern = [], []
    for _ in range(draw.randint(1, 3)):
        kind = draw.random()
        if kind < 0.5 or (kind < 0.75 and not depth):
            word = draw.choice("abc")
            markup.append(word)
            pattern.append(f"{word} ")
        elif kind < 0.75:
            inner, accepted = templates(draw, depth - 1)
            markup.append(f"<<optional>>{inner}<</optional>>")
            pattern.append(f"(?:{accepted})?")
        else:
            n = draw.randint(1, 2)
            markup.append(f"<<any:{n}>>")
            pattern.append(f"(?:[abc] ){{0,{n}}}")
    return " ".join(markup), "".join(pattern)


def test_automata_accept_what_their_markup_expands_to():
    draw = random.Random(8)
    texts = [list(x) for n in range(6) for x in itertools.product("abc", repeat=n)]
    tried = 0
    while tried < 60:
        markup, pattern = templates(draw, 2)
        try:
            a = Automaton("x", "a " + markup)
        except ValueError:
            continue
        tried += 1
        accepted = re.compile("a " + pattern)
        for words in texts:
            ends = [n for n in range(1, len(words) + 1) if accepted.fullmatch("".join(f"{w} " for w in words[:n]))]
            assert a.match(words, 0) == max(ends, default=-1), (markup, words)


def test_license_scan(spark):
    rows = [
        (1, "Under the MIT-License. mit license", "a"),
        (2, "Licensed under the Apache License, Version 2.0.", "a"),
        (3, "permit licenses", "a"),
        (4, "GENERAL Public license; licensed under the terms of the GNU General Public License, version 3.", "a"),
        (5, "licénsé mit licenseé", "a"),
    ] + small.AWKWARD
    docs = small.table(spark, rows)
    got = defaultdict(list)
    for r in license_scan(docs).collect():
        got[r.doc_id].append(r)
    assert tuple(got[1][0])[1:6] == (6, 2, 2, 4, "mit")
    assert got[2][0].labels == "apache,apache-2.0-notice" and got[2][0].first_word == 3
    assert (got[3][0].n_base, got[3][0].first_word, got[3][0].labels, got[3][0].score) == (0, None, "", 0.0)
    assert got[4][0].labels == "gpl,gpl-3.0,gpl-notice" and got[4][0].n_base == 2
    assert got[5][0].n_base == 0
    assert sum(map(len, got.values())) == len(rows)
    assert all(0 <= r.score <= 1 for rs in got.values() for r in rs)
    assert license_scan(small.table(spark, [])).count() == 0


def test_hash_of_nothing_left(spark):
    docs = small.table(spark, [(i, "same", "a") for i in range(10)])
    text = drop_common_lines(docs).select(F.sha2("text", 256)).first()[0]
    assert text == hashlib.sha256(b"").hexdigest()
