from tablewright.llm import licenses as x


def test_finds_without_long_words():
    found = x.Index(x.TEMPLATES).scan("Available under CC BY-NC 4.0", x.BAND, 0.7)
    assert [(r[0], r[1], r[2]) for r in found] == [("CC-BY-NC-4.0", 0.8, 4)]
    own = x.Index({"short": "Use it as you like."})
    assert [r[:2] for r in own.scan("do: use it as you like", x.BAND, 0.7)] == [("short", 1.0)]
