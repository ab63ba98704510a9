"""User extensions by name: context providers, mergers, prompt formatters, response sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

Provider = Callable[[DataFrame], DataFrame]


class ContextProvider:
    """Base of providers: a request table (request, buffer, line, col, ...) to contexts (request, content)."""

    name = "base"

    def __init__(self, **options):
        self.options = {**getattr(self, "defaults", {}), **options}

    def available(self) -> bool:
        return True

    def contexts(self, requests: DataFrame) -> DataFrame:
        raise NotImplementedError


@dataclass
class Registry:
    providers: dict[str, Provider] = field(default_factory=dict)
    priorities: dict[str, int] = field(default_factory=dict)
    formatters: dict[str, Callable[..., Column]] = field(default_factory=dict)
    sources: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    takes_context: set[str] = field(default_factory=lambda: {"chat"})

    def provider(self, name: str, provider: ContextProvider | Provider, priority: int = 10, enabled: bool | None = None) -> None:
        """Registers a provider instance or a bare function, unless it is disabled or not available."""
        if enabled is False or isinstance(provider, ContextProvider) and not provider.available():
            return
        self.providers[name] = provider.contexts if isinstance(provider, ContextProvider) else provider
        self.priorities[name] = priority

    def formatter(self, name: str, build: Callable[..., Column], takes_context: bool = False) -> None:
        self.formatters[name] = build
        if takes_context:
            self.takes_context.add(name)

    def gather(self, requests: DataFrame) -> DataFrame:
        """(request, source, priority, arrival, content) of all providers, those without content left out."""
        from functools import reduce

        from pyspark.sql import functions as F

        parts = [
            p(requests).select("request", F.lit(n).alias("source"), F.lit(self.priorities[n]).alias("priority"), F.lit(i).alias("arrival"), "content")
            for i, (n, p) in enumerate(self.providers.items())
        ]
        return reduce(DataFrame.unionByName, parts).where("content is not null") if parts else requests.select("request", F.lit("").alias("source"), F.lit(0).alias("priority"), F.lit(0).alias("arrival"), F.lit("").alias("content")).limit(0)


def deep_merge(base: dict, over: dict, force: bool = True) -> dict:
    """Nested options of both; where both have a plain value ``over`` wins if ``force``, else ``base``."""
    out = dict(base)
    for k, v in over.items():
        if isinstance(out.get(k), dict) and isinstance(v, dict):
            out[k] = deep_merge(out[k], v, force)
        elif force or k not in out:
            out[k] = v
    return out
