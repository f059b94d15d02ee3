"""Evaluation documents as text for a terminal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

CLASSES_SHOWN = 50  # lines of a class table; the written tables have all classes
MATRIX_SHOWN = 30  # classes up to which the matrix is drawn


def _share(value: float | None) -> str:
    return "-" if value is None else f"{value:.4f} ({100 * value:.2f} %)"


def _number(value: float | None) -> str:
    return "-" if value is None else f"{value:.4f}"


def aligned(rows: Sequence[Sequence[object]]) -> list[str]:
    """Lines of columns that are flush right."""
    widths = [max(len(str(row[i])) for row in rows) for i in range(len(rows[0]))] if rows else []
    return ["  " + "  ".join(str(value).rjust(width) for value, width in zip(row, widths)) for row in rows]


def class_table(metrics: Mapping) -> list[str]:
    """Precision, recall, F1, F2 and support of each class, then both means."""
    scores = ("precision", "recall", "f1", "f2")
    classes = metrics.get("classes", {})
    rows: list[Sequence[object]] = [("class", *scores, "support")]
    for name, own in list(classes.items())[:CLASSES_SHOWN]:
        rows.append((name, *[_number(own[s]) for s in scores], own["support"]))
    for mean in ("macro", "weighted"):
        rows.append((mean, *[_number(metrics.get(f"{mean}_{s}")) for s in scores], metrics["examples"]))
    more = len(classes) - CLASSES_SHOWN
    return aligned(rows) + ([f"  and {more} more classes, all of them in the tables"] if more > 0 else [])


def matrix_lines(metrics: Mapping) -> list[str]:
    """The confusion matrix, a line for each true and a column for each predicted class."""
    names = list(metrics.get("classes", {}))
    if len(names) > MATRIX_SHOWN or not names:
        return [f"  {len(names) or 'many'} classes, see the tables"]
    cells = {(str(label), str(pred)): n for label, pred, n in metrics.get("confusion", [])}
    rows: list[Sequence[object]] = [("", *names)]
    rows += [(label, *[cells.get((label, pred), 0) for pred in names]) for label in names]
    return aligned(rows)


def dataset_lines(name: str, metrics: Mapping) -> list[str]:
    """Everything about one dataset: overall values, classes, matrix, and accuracy of each class."""
    overall = [
        ("examples", metrics["examples"]), ("accuracy", _share(metrics["accuracy"])), ("macro F1", _number(metrics["macro_f1"])),
        ("macro F2", _number(metrics["macro_f2"])), ("macro recall", _number(metrics["macro_recall"])), ("mean loss", _number(metrics.get("loss"))),
    ]
    shown = list(metrics.get("classes", {}).items())[:CLASSES_SHOWN]
    return [
        name, "-" * len(name),
        *[f"  {title}: {value}" for title, value in overall],
        "classes", *class_table(metrics),
        "confusion (lines: true class, columns: predicted)", *matrix_lines(metrics),
        "accuracy by class", *[f"  {label}: {_share(own['recall'])}" for label, own in shown],
    ]


def evaluation_text(document: Mapping) -> str:
    """What was skipped and why, every dataset in full, and one line per dataset at the end."""
    lines = [f"{name} skipped: {reason}" for name, reason in document["skipped"].items()]
    for name, metrics in document["datasets"].items():
        lines += ["", *dataset_lines(name, metrics)]
    heads = ("dataset", "examples", "accuracy", "macro F1", "macro F2", "macro recall")
    rows: list[Sequence[object]] = [heads]
    for name, m in document["datasets"].items():
        rows.append((name, m["examples"], _share(m["accuracy"]), *[_number(m[c]) for c in ("macro_f1", "macro_f2", "macro_recall")]))
    return "\n".join([*lines, "", *aligned(rows)])
