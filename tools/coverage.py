"""Write COVERAGE.md: which registered query or test covers which survey item."""

from __future__ import annotations

import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

# items that write files or only choose columns, which a test covers beside the query
TESTED = {
    "S02": ("sources.readers.scan", "tests/test_loading.py"),
    "S08": ("sources.writers.save_processed", "tests/test_loading.py"),
    "S09": ("sources.writers.save_predictions", "tests/test_loading.py"),
    "S10": ("sources.readers.read_table", "tests/test_loading.py"),
    "S12": ("sources.writers.save_forecasts", "tests/test_loading.py"),
    "S13": ("sources.registry.ModelRegistry", "tests/test_learners.py"),
    "S14": ("sources.registry.RunLog", "tests/test_loading.py"),
    "F04": ("operators.filters.feature_columns", "tests/test_loading.py"),
    "M18": ("operators.monitoring.record_metrics, read_log", "tests/test_windows.py"),
    "D06": ("operators.monitoring.record_predictions", "tests/test_windows.py"),
    "D10": ("operators.monitoring.record_training, last_training", "tests/test_windows.py"),
}
COUNTS = {"S": 14, "F": 10, "Q": 14, "C": 11, "T": 10, "G": 22, "W": 5, "P": 15, "M": 20, "B": 12, "I": 8, "D": 11}


def main() -> None:
    from panelloom.registered import REGISTERED

    by_item: dict[str, list[str]] = {}
    for q in REGISTERED.values():
        for item in q.items:
            by_item.setdefault(item, []).append(f"`{q.name}`" + ("" if q.sql else " (rows only)"))
    lines = ["# Coverage", "", "Survey item → registered queries (checked against SQL unless marked), or API and test.", "", "| Item | Covered by |", "|---|---|"]
    missing = []
    for group, count in COUNTS.items():
        for i in range(1, count + 1):
            item = f"{group}{i:02d}"
            parts = by_item.get(item, [])
            if item in TESTED:
                parts = [*parts, "`{}` in {}".format(*TESTED[item])]
            if not parts:
                missing.append(item)
            lines.append(f"| {item} | {', '.join(parts) or '—'} |")
    (ROOT / "COVERAGE.md").write_text("\n".join(lines) + "\n", encoding="utf-8")
    print("missing:", missing)


if __name__ == "__main__":
    main()
