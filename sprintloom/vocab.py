"""Business words the reports depend on, gathered in one configuration object."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TeamRule:
    """Which team an issue belongs to; the first matching line wins.

    An issue on ``ai_board`` belongs to ``ai_team``; otherwise a sprint name that holds one
    of ``b_markers`` means ``b_team``; everything else, a null sprint included, is ``default_team``.
    """

    ai_board: str = "AI Board"
    main_board: str = "Main Board"
    ai_team: str = "AI&Analytics"
    b_markers: tuple[str, ...] = ("ScrumB", "Scrum B")
    b_team: str = "B Scrum"
    default_team: str = "A Scrum"

    @property
    def teams(self) -> tuple[str, ...]:
        return (self.default_team, self.b_team, self.ai_team)

    def board_of(self, team: str | None) -> str | None:
        """Board whose leaderboard is shown for a team; no team means every board."""
        if team in (self.default_team, self.b_team):
            return self.main_board
        return self.ai_board if team == self.ai_team else None


@dataclass(frozen=True)
class Vocabulary:
    # Words and limits that reports must share to give the expected results.
    done_statuses: tuple[str, ...] = ("完了", "Done", "Closed", "Resolved", "Completed")
    done: str = "完了"
    in_progress: str = "進行中"
    todo: str = "To Do"
    priorities: tuple[str, ...] = ("Highest", "High", "Medium", "Low", "Lowest")
    urgent_priorities: tuple[str, ...] = ("Highest", "High")
    urgent_words: tuple[str, ...] = ("優先", "緊急")
    hotfix_words: tuple[str, ...] = ("hotfix", "Hotfix", "HOTFIX", "ホットフィックス")
    defect_words: tuple[str, ...] = ("バグ", "bug", "Bug", "不具合", "障害")
    raise_words: tuple[str, ...] = ("優先", "緊急", "バグ", "不具合", "障害")
    raise_words_any_case: tuple[str, ...] = ("bug",)
    raise_types: tuple[str, ...] = ("bug", "バグ")
    raised_priority: str = "High"
    sprint_states: tuple[str, ...] = ("active", "future", "closed")
    all_teams: str = "全チーム"
    unknown_author: str = "Unknown"
    report_start: str = "2025-12-08"
    team_rule: TeamRule = field(default_factory=TeamRule)


DEFAULT = Vocabulary()
