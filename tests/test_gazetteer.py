"""Names in texts: leftmost, longest, without overlaps; and the mentions that they become."""

import random
import re

import pytest

from docweave.operators import relate

MENTIONS = "id long, file_id long, pos int, etype string, surface string, role string, attrs map<string,string>, confidence double, entity_id long, method string"


def alternation(texts, names):
    """The longest name first in one pattern of whole words, found from left to right."""
    pattern = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(a) for a in sorted({a for a, _ in names if a}, key=lambda a: (-len(a), a))) + r")(?!\w)")
    return sorted((f, e, m[0], m.start()) for f, text in texts for m in pattern.finditer(text or "") for a, e in names if a == m[0])


@pytest.mark.parametrize("few", [True, False])
def test_occurrences_are_those_of_one_pattern(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(relate, "LOOKUP_NAMES", 0)
    rng = random.Random(2)
    words = ["Acme", "Tool", "Works", "Acme Tool", "of", "Öl", "A", "B-C", "Tools"]
    names = sorted({(" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))), n) for n in range(25)}) + [("Acme Tool", 90), ("Tool Works", 91), ("", 92)]
    texts = [(n, rng.choice(["", "x"]) + "".join(rng.choice(words) + rng.choice([" ", " ", " ", "-", "", ", "]) for _ in range(rng.randint(0, 40)))) for n in range(80)] + [(100, None), (101, ""), (102, "Acme Tool Works")]
    got = relate.gazetteer_mentions(spark.createDataFrame(texts, "file_id long, text string").repartition(3), spark.createDataFrame(names, "alias string, entity_id long"))
    assert sorted(map(tuple, got.collect())) == alternation(texts, names)
    none = spark.createDataFrame([], "alias string, entity_id long")
    assert relate.gazetteer_mentions(spark.createDataFrame(texts, "file_id long, text string"), none).count() == 0


def test_text_mentions(spark):
    mentions = spark.createDataFrame(
        [
            (10, 1, 0, "document", "a note", "self", {}, 1.0, 7, "new"),
            (11, 1, 1, "company", "Acme Tool", "bill_to", {}, 1.0, 3, "new"),
            (20, 2, 0, "document", "pruned", "self", {}, 1.0, None, None),
            (30, 3, 0, "document", "b note", "self", {}, 1.0, 8, "new"),
        ],
        MENTIONS,
    )
    entities = spark.createDataFrame([(3, "company"), (4, "person"), (5, "company")], "id long, etype string")
    hits = spark.createDataFrame([(1, 3, "Acme Tool", 0), (1, 4, "Bo Reed", 9), (1, 4, "B. Reed Jr", 30), (1, 5, "Best Works", 50), (2, 4, "Bo Reed", 0), (3, 5, "Best Works", 0), (3, 5, "Best Works", 40)], "file_id long, entity_id long, alias string, start int")
    named = relate.text_mentions(hits, mentions, entities)
    assert named.schema.simpleString() == mentions.schema.simpleString()
    rows = sorted((r.file_id, r.id, r.pos, r.etype, r.surface, r.role, r.entity_id, r.method, r.confidence) for r in named.collect())
    assert rows == [
        (1, 12, 2, "person", "B. Reed Jr", "text_mention", 4, "gazetteer", 0.6), (1, 13, 3, "company", "Best Works", "text_mention", 5, "gazetteer", 0.6), (3, 31, 1, "company", "Best Works", "text_mention", 5, "gazetteer", 0.6),
    ]
    facts = relate.link_gazetteer(named, mentions)
    assert sorted((r.file_id, r.src, r.rel, r.dst) for r in facts.collect()) == [(1, 7, "MENTIONS", 4), (1, 7, "MENTIONS", 5), (3, 8, "MENTIONS", 5)]
