"""Options of an approximate index, with the messages a user of the SQL form knows."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from . import messages

METRICS = ("cosine", "ip", "l2sq")
MAX_K = 2048


class IndexError_(ValueError):
    """A wrong index definition or name."""


@dataclass(frozen=True)
class IndexOptions:
    metric: str = "l2sq"
    ef_construction: int = 128
    ef_search: int = 64
    M: int = 16
    M0: int = 32

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def parse(cls, given: dict) -> IndexOptions:
        """Names are read without regard to case; M sets M0 to twice its value unless M0 is given."""
        names, least = {n.lower(): n for n in ("metric", "ef_construction", "ef_search", "M", "M0")}, {"ef_construction": 1, "ef_search": 1, "M": 2, "M0": 2}
        found: dict = {}
        for key, value in given.items():
            name = names.get(key.lower())
            if name is None:
                raise IndexError_(messages.OPTION_UNKNOWN.format(key))
            if name == "metric":
                if not isinstance(value, str):
                    raise IndexError_(messages.METRIC_KIND)
                if value.lower() not in METRICS:
                    raise IndexError_(messages.METRIC_NAME.format(", ".join(f"'{m}'" for m in METRICS)))
                value = value.lower()
            else:
                if not isinstance(value, int) or isinstance(value, bool):
                    raise IndexError_(messages.OPTION_KIND.format(name))
                if value < least[name]:
                    raise IndexError_(messages.OPTION_LEAST.format(name, least[name]))
            found[name] = value
        if "M" in found and "M0" not in found:
            found["M0"] = 2 * found["M"]
        return cls(**found)
