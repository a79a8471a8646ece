"""Templates that look back further than a segment of turns."""

import pytest

from weatherloom.llm import chat


def templates():
    """Inner functions, which reach the workers by value."""

    def drops_first(turns):
        return "".join(f"{role}: {text};" for role, text in (turns[1:] if len(turns) > 40 else turns))

    def numbered(turns):
        return "".join(f"{i} {role}: {text};" for i, (role, text) in enumerate(turns))

    def repeats_system(turns):
        return "".join(f"[{turns[0][1]}] {text};" for _, text in turns)

    return [drops_first, numbered, repeats_system, chat.turn_template]


TURNS = [("user" if i % 2 else "system", f"text {i}") for i in range(100)]


@pytest.mark.parametrize("template", templates())
def test_long_conversations_are_rendered_from_their_start(spark, template):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(TURNS)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    found = sorted(chat.format_conversations(df, template).collect(), key=lambda r: r.position)
    outputs = [template(TURNS[:n]) for n in range(len(TURNS) + 1)]
    assert [r.rewrites for r in found] == [
        not after.startswith(before) for before, after in zip(outputs, outputs[1:])
    ]
    assert any(r.rewrites for r in found) == (template.__name__ == "drops_first")
    if template.__name__ != "drops_first":
        assert "".join(r.piece for r in found) == outputs[-1]
        assert all(r.span_end == len(after) for r, after in zip(found, outputs[1:]))
        assert [chat.unescape(r.piece[r.text_start : r.text_end]) for r in found][1:] == [t for _, t in TURNS][1:]


def test_a_declared_look_back_gives_the_same_for_a_bounded_template(spark):
    rows = [(1, i, role, text) for i, (role, text) in enumerate(TURNS)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    whole = chat.format_conversations(df).collect()
    assert chat.format_conversations(df, look_back=chat.TURN_LOOK_BACK).collect() == whole


def test_a_declared_look_back_is_held_against_whole_renderings(spark):
    rows = [(c, i, r, t) for c, n in ((1, 100), (2, 32), (3, 1)) for i, (r, t) in enumerate(TURNS[:n])]
    rows += [(None, None, None, None), (4, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(3)

    def held(template, look_back):
        found = chat.look_back_holds(df, template, look_back).collect()
        return {r.conv_id: r.holds for r in found}

    drops_first, numbered, repeats_system, own = templates()
    assert held(own, chat.TURN_LOOK_BACK) == dict.fromkeys((1, 2, 3, 4, None), True)
    # Segments start anew after 32 turns.
    for template in (numbered, repeats_system):
        assert held(template, 0) == {**dict.fromkeys((2, 3, 4, None), True), 1: False}
    assert not held(drops_first, 4)[1] and held(drops_first, 4)[2]


def test_the_look_back_of_our_template_holds_for_all_conversations(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    found = chat.look_back_holds(given, chat.turn_template, chat.TURN_LOOK_BACK)
    assert found.where("NOT holds").count() == 0 < found.count()
