"""Configuration of an index: what is searched, filtered, sorted and shown, and how."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
from dataclasses import dataclass, field

from lexigrove.errors import InvalidConfiguration

RANKING_RULES = ("words", "typo", "proximity", "attribute", "exactness")
#: What each further rule weighs, as a share of the rule before, and each further searchable attribute.
RULE_DECAY, ATTRIBUTE_DECAY = 0.7, 0.8
MAX_NAME_BYTES = 64
_NAME = re.compile(r"[a-zA-Z\u007f-\U0010ffff][a-zA-Z0-9_\u007f-\U0010ffff]*")


@dataclass(frozen=True)
class TypoTolerance:
    """How many typos words of a length may have; a wrong first letter can count twice."""

    enabled: bool = True
    thresholds: dict[int, int] = field(default_factory=lambda: {9: 2, 5: 1})
    first_letter_counts_double: bool = True
    for_prefixes: bool = False
    alphabet_size: int = 4
    index_length: int = 14

    def __post_init__(self) -> None:
        for length, typos in self.thresholds.items():
            if not isinstance(length, int) or not isinstance(typos, int) or length < 1 or typos < 0:
                raise InvalidConfiguration("Typo thresholds need positive lengths and typo counts of at least 0.")
        if self.alphabet_size < 1 or self.index_length < 1:
            raise InvalidConfiguration("Alphabet size and index length must be positive.")

    def allowed(self, term: str) -> int:
        """Typos that are allowed for a term."""
        if not self.enabled:
            return 0
        return next((typos for length, typos in sorted(self.thresholds.items(), reverse=True) if len(term) >= length), 0)


def check_name(name: str) -> None:
    if not _NAME.fullmatch(name) or len(name.encode()) > MAX_NAME_BYTES:
        raise InvalidConfiguration(f"Not a valid attribute name: {name!r}.")


@dataclass(frozen=True)
class IndexConfig:
    primary_key: str = "id"
    searchable: tuple[str, ...] = ("*",)
    filterable: tuple[str, ...] = ()
    sortable: tuple[str, ...] = ()
    displayed: tuple[str, ...] = ("*",)
    languages: tuple[str, ...] = ()
    stop_words: tuple[str, ...] = ()
    max_query_tokens: int = 10
    max_total_hits: int = 1000
    min_prefix_length: int = 3
    ranking_rules: tuple[str, ...] = RANKING_RULES
    typo: TypoTolerance = field(default_factory=TypoTolerance)

    def __post_init__(self) -> None:
        for name in ("searchable", "filterable", "sortable", "displayed", "languages", "stop_words", "ranking_rules"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        for name in ("filterable", "sortable"):
            object.__setattr__(self, name, tuple(sorted(getattr(self, name))))
        for name in {self.primary_key, *self.searchable, *self.filterable, *self.sortable, *self.displayed} - {"*"}:
            check_name(name)
        if not self.ranking_rules:
            raise InvalidConfiguration("At least one ranking rule is needed.")
        for rule in self.ranking_rules:
            if rule not in RANKING_RULES:
                raise InvalidConfiguration(f"Unknown ranking rule {rule!r}; there are {', '.join(RANKING_RULES)}.")

    def with_(self, **changes) -> IndexConfig:
        return dataclasses.replace(self, **changes)

    @property
    def schema_attributes(self) -> tuple[str, ...]:
        """Attributes whose types are fixed by the documents."""
        return tuple(dict.fromkeys((self.primary_key, *(a for a in self.searchable if a != "*"), *self.filterable, *self.sortable)))

    def attribute_weights(self) -> dict[str, float]:
        """Weight of each searchable attribute, in their order; none if all are searchable."""
        if "*" in self.searchable:
            return {}
        return {a: round(ATTRIBUTE_DECAY**i, 2) for i, a in enumerate(self.searchable)}

    def to_dict(self) -> dict:
        out = dataclasses.asdict(self)
        out["typo"]["thresholds"] = {str(k): v for k, v in self.typo.thresholds.items()}
        return json.loads(json.dumps(out))

    @staticmethod
    def from_dict(data: dict) -> IndexConfig:
        data = dict(data)
        if "typo" in data:
            typo = dict(data["typo"])
            if "thresholds" in typo:
                typo["thresholds"] = {int(k): v for k, v in typo["thresholds"].items()}
            data["typo"] = TypoTolerance(**typo)
        return IndexConfig(**data)

    def hash(self) -> str:
        """Changes with whatever needs documents to be indexed anew; not with what is only shown or how hits are ranked."""
        data = self.to_dict()
        for name in ("displayed", "ranking_rules", "max_query_tokens", "min_prefix_length"):
            data.pop(name)
        data["typo"].pop("thresholds")
        return hashlib.sha256(json.dumps(data, sort_keys=True).encode()).hexdigest()
