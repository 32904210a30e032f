"""Plain versions shared by tests."""

from test_decontaminate import by_hand as _contamination
from test_line_dedup import by_hand as line_by_hand  # noqa: F401
from test_probminhash import classes_by_hand as near_classes  # noqa: F401


def contaminated_words(docs, items):
    return {row[0]: row[2] for row in _contamination(docs, items)}
