"""Personal data in long stretches of pieces."""

from glyphmill.llm import pii


def test_number_across_piece_64():
    field = pii.trained()
    phone = "(212) 555 0187"
    want = set()
    for lead in range(58, 70):
        head = "7 " * lead
        text = head + phone + " 7" * 70
        assert len(list(pii.pieces(text))) == 1
        got = pii.added(text, [], field)
        want.add((len(head), len(head) + len(phone), 3) in got)
    assert want == {True}


def test_best_is_the_best_of_all_segmentations():
    field = pii.trained()
    text = "12 345 6789 1.2.3.4 0049 30"
    (stretch,) = pii.pieces(text)
    rows = list(pii.lattice(text, stretch))
    scores = field.scores(rows)

    def paths(j):
        """(score, last label, segments) of all ways to cover the first j pieces."""
        if not j:
            yield None, None, []
            return
        for i, own in scores[j]:
            for v, z, segments in paths(i):
                for y in range(pii.LABELS):
                    if y != pii.NONE or j - i == 1:
                        yield (v or 0.0) + field.move[pii.NONE if z is None else z][y] + own[y], y, [*segments, (i, j, y)]

    assert max(paths(len(stretch)), key=lambda x: x[0])[2] == field.best(rows)
