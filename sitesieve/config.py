"""Options of a run, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass

from .functions import content


@dataclass(frozen=True)
class SieveConfig:
    """What a run keeps and when it stops a site.

    ``langs_of_interest`` and ``user_agent`` must be given. ``accepted_tlds`` is the list of public suffixes whose
    sites may be entered from a page of another site. Sizes are megabytes, times are seconds. A ``None`` budget is no
    budget.
    """

    langs_of_interest: tuple[str, ...]
    user_agent: str
    accepted_tlds: tuple[str, ...] = ()
    # Defaults of the options
    crawl_delay: int = 3
    max_time_per_site: int | None = None
    max_size_per_site: int | None = None
    prefix_filter: tuple[str, ...] = ()
    accepted_content: str = "(text/html)"
    max_folder_tree_depth: int = 20
    max_attempts: int = 3
    scout_steps: int = 200
    min_langs_in_site: int = 2
    mandatory_lang: str | None = None
    min_percent_mandatory_lang: int = 10
    url_blacklist: tuple[str, ...] = ()
    # Language: what a word is, and when a page is reliable: at least 1 word in 20 is a profile word of its best
    # language, and the second language has at most 9 hits for 10 of the best
    word_pattern: str = content.WORD
    lang_min_share: tuple[int, int] = (20, 1)
    lang_max_rival: tuple[int, int] = (10, 9)
