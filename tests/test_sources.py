import json

import pytest

from quire.functions.glyphs import decode_label, reorder_closing
from quire.sources import config, css

GOOD = {"schema_version": 1, "source": {"folder": ".", "pdf": "a.pdf"}, "metadata": {"title": "T", "creators": ["C"], "language": "en"}, "pages": {"cover": [1], "front": [2, 4], "body": [5, 90], "exclude": ["7-9", 12]}, "flow": {"dehyphenate": "off"}}


def test_config(spark):
    c = config.load(json.dumps(GOOD))
    assert c.ranges == {"front": (2, 4), "body": (5, 90)} and c.exclude == [7, 8, 9, 12] and len(c.sha256) == 64
    pages = spark.range(1, 15).selectExpr("cast(id as int) page")
    assert sorted(r["page"] for r in config.in_flow(pages, c).collect()) == [2, 3, 4, 5, 6, 10, 11, 13, 14]


@pytest.mark.parametrize("change", [
    {"extra": 1}, {"schema_version": True}, {"schema_version": 2}, {"source": {"folder": "."}}, {"source": {"folder": ".", "pdf": "a", "more": 1}},
    {"metadata": {"title": "T", "creators": ["C"]}}, {"metadata": {**GOOD["metadata"], "released": "2024-13-01"}}, {"metadata": {**GOOD["metadata"], "title": "TODO title"}},
    {"pages": {"front": [2, 6], "body": [5, 9]}}, {"pages": {"label_source": "guess"}}, {"flow": {"overrides": [{"action": "burn"}]}}, {"flow": {"columns": [{"pages": [1], "count": 1}]}},
])
def test_config_is_closed(change):
    with pytest.raises(config.ConfigError):
        config.load(json.dumps(GOOD | change))


def test_assertions():
    good = {"page": "3", "type": "present", "text": "some words", "note": "seen"}
    assert config.assertions([good])[0]["boundary"] is None
    for bad in ({"page": 3}, {"type": "maybe"}, {"note": ""}, {"text": "abc"}, {"text2": "x"}, {"type": "order", "text2": "some"}, {"pno": True}, {"why": 1}):
        with pytest.raises(config.ConfigError):
            config.assertions([good | bad])
    assert config.assertions([good | {"text": "abc", "boundary": True}, good | {"type": "order", "text2": "other text"}])


def test_css():
    rules = css.parse("/* p{x:1} */ @media a {b{c:d}} p, .it {font-style: italic; font-size:.5em} blockquote p {font-size: .8em} p.it{color:red} a b c{x:y} p:hover{x:y} h1{}")
    assert [r.order for r in rules] == [0, 1, 2, 3]
    none = frozenset()
    path = [("body", none), ("blockquote", none), ("p", frozenset(["it"]))]
    assert css.resolve(rules, path) == {"font-style": "italic", "font-size": ".5em", "color": "red"}
    assert css.font_size(rules, [("blockquote", none), ("p", none)]) == 0.8 and css.resolve(rules, [("div", none)]) == {}


def test_closing_signs_go_behind_the_run():
    line = [("a", 0, 5), ("(", 5, 8), (")", 30, 33), (",", 33, 35), ("י", 20, 30), ("ה", 10, 20), ("b", 40, 45)]
    out, moved = reorder_closing(line)
    assert "".join(g[0] for g in out) == "a(יה),b" and moved == 2
    assert reorder_closing([("a", 0, 1), ("b", 1, 2)])[1] == 0


def test_labels():
    assert decode_label("p<FEFF00690076>x") == "pivx" and decode_label("<zz> <12>") == "<zz> <12>"
