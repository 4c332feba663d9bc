"""The line rules judge lines of every size alike."""

from lumenspan.llm import line_rules


def judged(line):
    return line_rules.judge(line, line_rules.WORDS.findall(line), set())


def test_shouting_is_seven_tenths_of_the_whole_line():
    assert judged("BUY NOW this IS THE BEST DEAL EVER") == "shouting"
    assert judged("1 2 3 " * 40 + "and THE BEST DEAL EVER SEEN BY ANYONE") == "shouting"
    assert judged("ÉTÉ À LA MER, le PLUS BEAU PRIX") == "shouting"
    assert judged("ABCDEFG hij is.") == "" and judged("A good line of text that SAYS SOMETHING.") == ""
    assert judged("CAPITALS AT FIRST " * 20 + "then words that are small as usual " * 20) != "shouting"
    assert line_rules.cases("aB1 é") == (1, 3) and line_rules.cases("aB1 e") == (1, 3)


def test_repetition_is_the_same_at_every_length():
    import random

    rng = random.Random(5)
    for n in (1999, 2000, 2500, 9000):
        assert judged(" ".join(f"key{rng.randrange(300)}" for _ in range(n))) == "repetition", n
        assert judged(" ".join(f"key{int(3000 * rng.random() ** 2)}" for _ in range(n)) + ".") == "", n


def test_kinds_by_windows(monkeypatch):
    import random

    rng = random.Random(2)
    monkeypatch.setattr(line_rules, "SPAN", 30)
    for n in (1, 10, 30, 31, 57, 90):
        words, span = [rng.choice("abcdefghijklmnop") for _ in range(n)], min(n, 30)
        assert line_rules.kinds(words) == (sum(len(set(words[k : k + span])) for k in range(n - span + 1)), span * (n - span + 1))


def test_a_notice_fails_a_line_by_its_share():
    essay = " ".join(f"word{k} other{k * 7}" + ("." if k % 9 == 0 else "") for k in range(2400)) + "."
    assert judged(essay) == "" and judged(essay + " He read the privacy policy once.") == "" and line_rules.assess(essay + " He read the privacy policy once.")["kept"]
    assert judged("Click here to accept all cookies.") == judged("We use cookies: see our cookie policy for what we store of you.") == "boilerplate"
    for n in (0, 5, 8, 9, 40):  # three words of n + 4
        line = "All rights reserved " + " ".join(f"w{k}" for k in range(n)) + " end."
        assert judged(line) == ("boilerplate" if 5 * 3 >= n + 4 else ""), n
    assert judged("Privacy policy, " * 3 + " ".join(f"w{k}" for k in range(24)) + ".") == "boilerplate"


def test_sentences_end_in_lines_of_every_size():
    assert judged("five words and no mark") == judged("one") == judged(" ".join(f"w{k}" for k in range(500))) == "punctuation"
    assert judged("five words and a mark.") == judged("ends, but not here") == judged("one.") == ""
    for n in (39, 40, 41, 400):
        marked = " ".join(f"w{k}" + ("." if k % 41 == 5 else "") for k in range(n)) + " more"
        assert judged(marked) == ("" if 40 * sum(k % 41 == 5 for k in range(n)) >= n + 1 else "punctuation"), n
    lines = "\n".join(f"a{k} b{k} c{k} d{k} e{k}" for k in range(12))
    assert not line_rules.assess(lines)["kept"] and line_rules.assess(lines.replace("\n", ".\n") + ".")["kept"]
