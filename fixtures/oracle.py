"""The same queries as SQL over the driver's tables."""

from __future__ import annotations

import re

from fixtures.model import AS_OF, EPOCH
from fixtures.queries import WATERMARK
from sprintloom.operators.scoring import PROMPT

DONE = "('完了', 'Done', 'Closed', 'Resolved', 'Completed')"
TEAM = """CASE WHEN i.board_name = 'AI Board' THEN 'AI&Analytics'
  WHEN contains(i.sprint_name, 'ScrumB') OR contains(i.sprint_name, 'Scrum B') THEN 'B Scrum'
  ELSE 'A Scrum' END"""


def _window(day: str) -> str:
    return f"(date_diff('day', DATE '{EPOCH}', CAST({day} AS DATE)) // 14)"


def _name(window: str, odd: str) -> str:
    return (f"('S' || lpad(CAST({window} AS VARCHAR), 3, '0') || "
            f"CASE WHEN {odd} = 0 THEN ' ScrumA' ELSE ' ScrumB' END)")


def _label(day: str) -> str:
    return (f"(CAST(isoyear({day}) AS VARCHAR) || '-W' || "
            f"lpad(CAST(weekofyear({day}) AS VARCHAR), 2, '0'))")


def _week(day: str) -> str:
    return f"CAST(date_trunc('week', {day}) AS DATE)"


def _any(column: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_SHIP = _window("l_shipdate")
_NOW, _NEXT = _name(_SHIP, "l_suppkey % 2"), _name(f"({_SHIP} + 1)", "l_suppkey % 2")
_START = f"(DATE '{EPOCH}' + CAST((sprint_id // 2) * 14 AS INTEGER))"
_MOVED = "CASE state WHEN 'future' THEN 'active' ELSE 'closed' END"
_COUNTS = """COUNT(*) AS total_issues,
  COUNT(*) FILTER (status_category = '完了') AS done_issues,
  COUNT(*) FILTER (status_category = '進行中') AS in_progress_issues,
  COUNT(*) FILTER (status_category = 'To Do') AS todo_issues,
  round(SUM(reported_sp), 1) AS total_sp,
  round(coalesce(SUM(reported_sp) FILTER (status_category = '完了'), 0), 1) AS done_sp,
  round(coalesce(SUM(reported_sp) FILTER (status_category = '進行中'), 0), 1) AS in_progress_sp,
  round(coalesce(SUM(reported_sp) FILTER (status_category = 'To Do'), 0), 1) AS todo_sp"""
_RAISE = """(i.priority NOT IN ('High', 'Highest') AND (
  regexp_matches(i.summary, '優先|緊急|バグ|不具合|障害') OR contains(lower(i.summary), 'bug')
  OR lower(i.issuetype) IN ('bug', 'バグ')))"""

# Named sub-queries; each may use the ones it names.
VIEWS: dict[str, str] = {
    "issues": f"""SELECT 'K-' || o_orderkey AS key,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 'AI Board' ELSE 'Main Board' END AS board_name,
  CAST({_window('o_orderdate')} * 2 + o_custkey % 2 AS INTEGER) AS sprint_id,
  CASE WHEN o_orderkey % 31 <> 0 THEN {_name(_window('o_orderdate'), 'o_custkey % 2')} END AS sprint_name,
  CASE WHEN o_orderkey % 13 = 0 THEN '緊急 ' WHEN o_orderkey % 29 = 0 THEN 'Hotfix '
       WHEN o_orderkey % 37 = 0 THEN 'バグ ' ELSE '' END || 'order ' || o_orderkey AS summary,
  CASE WHEN o_custkey % 23 <> 0 THEN 'dev' || lpad(CAST(o_custkey % 40 AS VARCHAR), 2, '0') END AS assignee,
  CAST(floor(o_totalprice / 25000) / 2 AS DOUBLE) AS reported_sp,
  CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'In Progress' WHEN 'P' THEN 'To Do' END AS status,
  CASE o_orderstatus WHEN 'F' THEN '完了' WHEN 'O' THEN '進行中' WHEN 'P' THEN 'To Do' END AS status_category,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Highest' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
       WHEN '4-NOT SPECIFIED' THEN 'Low' WHEN '5-LOW' THEN 'Lowest' END AS priority,
  CASE WHEN o_orderkey % 11 = 0 THEN 'Bug' ELSE 'Story' END AS issuetype,
  CASE WHEN o_orderstatus = 'F' THEN 'Done' END AS resolution,
  o_orderkey % 17 = 0 AS flagged,
  o_orderdate AS created,
  o_orderdate + to_days(CAST(o_orderkey % 20 AS INTEGER)) AS updated
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "described": """SELECT issues.*, text AS description
FROM issues LEFT JOIN documents ON issues.key = 'K-' || doc_id""",
    "changelog": f"""SELECT concat_ws('_', 'K-' || l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(l_quantity AS INTEGER)) AS id,
  'K-' || l_orderkey AS issue_key, 'supp' || l_suppkey AS author,
  CASE WHEN l_linestatus = 'F' THEN 'status' ELSE 'Sprint' END AS field,
  CASE WHEN l_linestatus = 'F' THEN 'To Do' ELSE {_NOW} END AS from_string,
  CASE WHEN l_linestatus = 'F'
       THEN CASE l_returnflag WHEN 'A' THEN 'Done' WHEN 'R' THEN '完了' WHEN 'N' THEN 'In Progress' END
       ELSE {_NOW} || ', ' || {_NEXT} END AS to_string,
  l_shipdate AS created
FROM lineitem""",
    "comments": """SELECT conv_id || '_' || turn AS id, 'K-' || conv_id AS issue_key, role AS author,
  text AS body, TIMESTAMP '2024-01-01' + to_hours(CAST(turn AS INTEGER)) AS created
FROM conversations""",
    "sprint_ids": "SELECT DISTINCT sprint_id FROM issues",
    "sprints": f"""SELECT sprint_id, 'Main Board' AS board_name,
  {_name('(sprint_id // 2)', 'sprint_id % 2')} AS sprint_name,
  CASE WHEN sprint_id // 2 >= 171 THEN 'future' WHEN sprint_id // 2 >= 169 THEN 'active'
       ELSE 'closed' END AS state,
  TIMESTAMP '{AS_OF}' AS synced_at,
  CASE WHEN sprint_id % 3 = 0 THEN CAST(100 AS DOUBLE) END AS planned_sp_snapshot,
  CASE WHEN sprint_id % 3 = 0 THEN CAST({_START} AS TIMESTAMP) END AS snapshot_created_at
FROM sprint_ids""",
    "metadata": f"""SELECT sprint_id, {_name('(sprint_id // 2)', 'sprint_id % 2')} AS sprint_name,
  CAST({_START} AS VARCHAR) AS start_date, CAST({_START} + 13 AS VARCHAR) AS end_date,
  CAST({_START} AS TIMESTAMP) AS created_at, CAST({_START} + 13 AS TIMESTAMP) AS updated_at
FROM sprint_ids""",
    "scores": f"""SELECT 'K-' || doc_id AS issue_key, 'toxic=' || toxic AS complexity_reasoning,
  CAST(quality * 0.5 + 0.25 AS DOUBLE) AS clarity_score, CAST(NULL AS VARCHAR) AS clarity_notes,
  TIMESTAMP '{AS_OF}' AS analyzed_at
FROM labels""",
    "weekly": f"""SELECT {_week('created')} AS week_start, board_name, assignee,
  SUM(reported_sp) AS reported_sp, COUNT(*) AS issue_count
FROM issues WHERE assignee IS NOT NULL GROUP BY ALL""",
    "bridge": """SELECT sprint_name, key AS issue_key FROM issues WHERE sprint_name <> ''
UNION
SELECT trim(part), issue_key FROM (
  SELECT issue_key, unnest(list_concat(string_split(coalesce(from_string, ''), ', '),
                                       string_split(coalesce(to_string, ''), ', '))) AS part
  FROM changelog WHERE field = 'Sprint') WHERE trim(part) <> ''""",
    "sprint_totals": """SELECT sprint_name, SUM(reported_sp) AS total_sp FROM issues
WHERE sprint_name IS NOT NULL GROUP BY sprint_name""",
    "future": "SELECT SUM(reported_sp) AS future_sp FROM issues WHERE status_category = 'To Do'",
    "history": f"""SELECT *, coalesce(future_sp / nullif(avg_velocity, 0) * 100, 0) AS sufficiency FROM (
  SELECT {_week('created')} AS snapshot_date,
    coalesce(SUM(reported_sp) FILTER (status_category = 'To Do'), 0) AS future_sp,
    SUM(reported_sp) AS avg_velocity
  FROM issues GROUP BY 1)""",
    "velocity3": """SELECT coalesce(avg(sp), 0) AS avg_velocity FROM (
  SELECT week_start, SUM(reported_sp) AS sp FROM weekly GROUP BY week_start
  ORDER BY week_start DESC LIMIT 3)""",
    "closings": f"""SELECT issue_key, created FROM changelog
WHERE field = 'status' AND to_string IN {DONE}""",
    "completed": "SELECT issue_key, CAST(min(created) AS DATE) AS completed_date FROM closings GROUP BY issue_key",
    "work": f"""SELECT {_week('completed_date')} AS week_start, {_label('completed_date')} AS week_label,
  completed_date, i.assignee, {TEAM} AS team, i.reported_sp
FROM issues i JOIN completed ON issue_key = key
WHERE i.assignee IS NOT NULL AND i.reported_sp > 0""",
    "velocity": """SELECT week_start, week_label, team, SUM(reported_sp) AS done_sp, COUNT(*) AS issue_count
FROM work GROUP BY ALL""",
    "individual": """SELECT week_start, week_label, assignee, team, SUM(reported_sp) AS done_sp,
  COUNT(*) AS issue_count FROM work GROUP BY ALL""",
    "recent": """SELECT week_start, team, done_sp FROM velocity
WHERE week_start >= (SELECT max(week_start) FROM velocity) - 56""",
    "teams": f"""SELECT {TEAM} AS team, COUNT(*) AS total_issues, round(SUM(reported_sp), 1) AS total_sp,
  round(coalesce(SUM(reported_sp) FILTER (status_category = '完了'), 0), 1) AS done_sp,
  round(coalesce(SUM(reported_sp) FILTER (status_category = '完了'), 0) / nullif(SUM(reported_sp), 0) * 100, 1)
    AS completion_pct,
  COUNT(DISTINCT assignee) AS member_count
FROM issues i GROUP BY 1""",
    "running": f"""SELECT i.* EXCLUDE (sprint_name), s.sprint_name, s.state, {TEAM} AS team
FROM issues i JOIN sprints s ON i.sprint_id = s.sprint_id WHERE s.state IN ('active', 'future')""",
    "progress": """SELECT sprint_name, team, state, COUNT(*) AS total_issues,
  COUNT(*) FILTER (status_category = '完了') AS done_issues,
  round(SUM(reported_sp), 1) AS total_sp,
  round(coalesce(SUM(reported_sp) FILTER (status_category = '完了'), 0), 1) AS done_sp
FROM running GROUP BY ALL""",
    "load": f"""SELECT assignee, {TEAM} AS team, COUNT(*) AS issue_count, round(SUM(reported_sp), 1) AS total_sp,
  COUNT(*) FILTER (status_category = '完了') AS done_count,
  COUNT(*) FILTER (status_category = '進行中') AS in_progress_count
FROM issues i WHERE assignee IS NOT NULL
  AND created >= (SELECT max(created) - INTERVAL 28 DAYS FROM issues) GROUP BY ALL""",
    "memberships": f"""SELECT b.sprint_name, {TEAM} AS team, i.reported_sp, i.created,
  i.status_category = '完了' AS is_done,
  i.status_category <> '完了' AND COUNT(*) OVER (PARTITION BY b.issue_key) > 1 AS is_carried
FROM bridge b JOIN issues i ON b.issue_key = i.key WHERE i.reported_sp > 0""",
    "achievement": """SELECT m.sprint_name, m.team, m.total_issues,
  coalesce(s.planned_sp_snapshot, m.now_sp) AS planned_sp, m.done_sp, m.carryover_sp, m.carryover_count,
  round(m.done_sp / nullif(coalesce(s.planned_sp_snapshot, m.now_sp), 0) * 100, 1) AS achievement_pct
FROM (SELECT sprint_name, team, COUNT(*) AS total_issues, round(SUM(reported_sp), 1) AS now_sp,
        round(coalesce(SUM(reported_sp) FILTER (is_done), 0), 1) AS done_sp,
        round(coalesce(SUM(reported_sp) FILTER (is_carried), 0), 1) AS carryover_sp,
        COUNT(*) FILTER (is_carried) AS carryover_count
      FROM memberships GROUP BY ALL) m
LEFT JOIN sprints s ON s.sprint_name = m.sprint_name""",
    "timeline": f"""SELECT week_start, team, SUM(planned) AS planned_sp, SUM(done) AS done_sp,
  SUM(carried) AS carryover_sp, round(SUM(done) / nullif(SUM(planned), 0) * 100, 1) AS achievement_pct
FROM (SELECT sprint_name, team, {_week('max(created)')} AS week_start, SUM(reported_sp) AS planned,
        coalesce(SUM(reported_sp) FILTER (is_done), 0) AS done,
        coalesce(SUM(reported_sp) FILTER (is_carried), 0) AS carried
      FROM memberships GROUP BY sprint_name, team)
GROUP BY week_start, team""",
    "source": f"SELECT sprint_id, sprint_name, {_MOVED} AS state FROM sprints",
    "selected": """SELECT * FROM source n WHERE NOT (n.state = 'closed' AND EXISTS (
  SELECT 1 FROM sprints s WHERE s.sprint_id = n.sprint_id AND s.state = 'closed'))""",
    "log": """SELECT n.sprint_id, n.sprint_name, n.state,
  CASE WHEN n.sprint_id IN (SELECT sprint_id FROM selected) THEN 'synced' ELSE 'skipped' END AS outcome,
  (SELECT COUNT(*) FROM issues i JOIN selected p ON p.sprint_id = i.sprint_id
   WHERE i.sprint_id = n.sprint_id) AS issues,
  (SELECT COUNT(*) FROM comments c JOIN issues i ON c.issue_key = i.key JOIN selected p ON p.sprint_id = i.sprint_id
   WHERE i.sprint_id = n.sprint_id) AS comments
FROM source n""",
    "raised": f"SELECT i.*, {_RAISE} AS is_raised FROM issues i",
    "assignee_means": "SELECT assignee, avg(done_sp) AS m FROM individual GROUP BY assignee",
    "team_means": """SELECT team, avg(m) AS team_mean FROM (
  SELECT assignee, team, avg(done_sp) AS m FROM individual GROUP BY ALL) GROUP BY team""",
    "per_pair": """SELECT assignee, team, SUM(done_sp) AS total_sp, CAST(SUM(issue_count) AS BIGINT) AS issue_count,
  COUNT(*) AS active_weeks, avg(done_sp) AS weekly FROM individual GROUP BY ALL""",
    "threads": """SELECT issue_key, string_agg('- ' || author || ': ' || body, chr(10) ORDER BY created, id) AS thread
FROM comments GROUP BY issue_key""",
}
_TEMPLATE = PROMPT.replace("'", "''").split("%s")
_SLOTS = ["key", "summary", "CAST(reported_sp AS VARCHAR)", "status", "coalesce(assignee, 'Unassigned')",
          "coalesce(nullif(description, ''), '(no description)')",
          "coalesce(nullif(thread, ''), '(no comments)')"]
VIEWS["prompts"] = (
    "SELECT key AS issue_key, "
    + " || ".join(f"'{text}'" + (f" || {slot}" if slot else "")
                  for text, slot in zip(_TEMPLATE, [*_SLOTS, ""], strict=True))
    + " AS prompt FROM described LEFT JOIN threads ON issue_key = key"
)

_NUMBER = "CAST(substr(key, 3) AS BIGINT)"
VIEWS["listed"] = f"""SELECT CAST(n * 2 + odd AS INTEGER) AS sprint_id, {_name('n', 'odd')} AS sprint_name,
  CASE WHEN n >= 171 THEN 'future' WHEN n >= 169 THEN 'active' WHEN n >= 1 THEN 'closed' ELSE '' END AS state,
  CAST(d AS VARCHAR) AS start_date, CAST(d + 13 AS VARCHAR) AS end_date,
  CASE WHEN n < 169 THEN CAST(d + 13 AS VARCHAR) END AS complete_date
FROM (SELECT n, unnest([0, 1]) AS odd, DATE '{EPOCH}' + CAST(n * 14 AS INTEGER) AS d
      FROM (SELECT DISTINCT {_window('o_orderdate')} AS n FROM orders))"""
VIEWS["long_comments"] = """SELECT id, 'K-' || (length(id) % 3 + 1) AS issue_key, author, to_string AS body, created
FROM changelog"""
VIEWS["long_threads"] = VIEWS["threads"].replace("FROM comments", "FROM long_comments")
VIEWS["long_prompts"] = VIEWS["prompts"].replace("JOIN threads", "JOIN long_threads")


def with_views(body: str) -> str:
    """The statement with the views it mentions, directly or through others, as CTEs."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b|PIVOT {name}\b", sql):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH {ctes}\n{body}" if needed else body


def _ranking(rows: str, where: str = "true") -> str:
    return f"""SELECT assignee, COUNT(*) AS issue_count, round(SUM(reported_sp), 1) AS total_sp
FROM {rows} WHERE assignee IS NOT NULL AND {where} GROUP BY assignee"""


def _recent_ranking(weeks_back: int, where: str) -> str:
    newest = f"(SELECT max({_week('completed_date')}) FROM completed) - {7 * weeks_back}"
    return _ranking("issues JOIN completed ON issue_key = key", f"completed_date >= {newest} AND {where}")


def _weekly(key: str = "", where: str = "true") -> str:
    return f"""SELECT week_start, {key} SUM(reported_sp) AS reported_sp,
  CAST(SUM(issue_count) AS BIGINT) AS issue_count FROM weekly WHERE {where} GROUP BY ALL"""


_LIST = "key, summary, status, status_category, priority, assignee, sprint_name, team, reported_sp"
_IDLE = f"CAST(DATE '{AS_OF}' - CAST(updated AS DATE) AS INTEGER)"
_UPDATED = "CAST(updated AS DATE) AS updated_date"
_URGENT = "(" + _any("summary", "優先", "緊急", "hotfix", "Hotfix", "HOTFIX", "ホットフィックス") + \
    " OR priority IN ('Highest', 'High'))"
_ATTENTION = f"""(status_category <> '完了' AND ({_URGENT} OR flagged
  OR {_any("summary", "バグ", "bug", "Bug", "不具合", "障害")}))"""
_OVERALL = "(SELECT avg(m) FROM assignee_means)"
_INGESTED = """SELECT key, board_name, sprint_id, sprint_name, summary, assignee, reported_sp, status,
  status_category, priority, issuetype, resolution, flagged, created, updated,
  coalesce(description, '') AS description"""
_SNAPSHOT_COLUMNS = "sprint_id, board_name, sprint_name, state, synced_at"


def _snapshots(take: str, value: str, table: str, state: str = "s.state",
               old_value: str = "s.planned_sp_snapshot", old_at: str = "s.snapshot_created_at") -> str:
    return f"""SELECT s.sprint_id, s.board_name, s.sprint_name, {state} AS state, s.synced_at,
  CASE WHEN {take} THEN {value} ELSE {old_value} END AS planned_sp_snapshot,
  CASE WHEN {take} THEN TIMESTAMP '{AS_OF}' ELSE {old_at} END AS snapshot_created_at
FROM sprints s LEFT JOIN {table}"""


_DASHBOARD = {
    "velocity": "FROM velocity", "teamSummary": "FROM teams", "recentTrend": "FROM recent",
    "sprintProgress": "FROM progress", "sprintAchievement": "FROM achievement",
    "sprintAchievementTimeline": "FROM timeline", "assigneeLoad": "FROM load",
    "leaderboard": f"FROM ({_ranking('issues')})",
    "leaderboardPeriods.last_week": f"FROM ({_recent_ranking(0, 'true')})",
    "leaderboardPeriods.last_3_weeks": f"FROM ({_recent_ranking(2, 'true')})",
    "statusBreakdown": "FROM (SELECT DISTINCT status_category FROM issues)",
    "individualVelocity": "FROM individual", "issues": "FROM issues",
    "sufficiency": "FROM (SELECT max(snapshot_date) FROM history)",
    "activeSprintDetails": "FROM (SELECT DISTINCT sprint_id, team FROM running WHERE state = 'active')",
    "activeSprintIssues": "FROM running WHERE state = 'active'",
    "sprintBurndown": """FROM (SELECT DISTINCT sprint_name, team, CAST(c.created AS DATE)
      FROM running JOIN closings c ON issue_key = key WHERE state = 'active')""",
    "sprintMemberWorkload": """FROM (SELECT DISTINCT sprint_name, team, assignee
      FROM running WHERE state = 'active' AND assignee IS NOT NULL)""",
    "highPriorityIssues": f"FROM running WHERE state = 'active' AND {_ATTENTION}",
    "stalledIssues": f"FROM running WHERE state = 'active' AND status_category <> '完了' AND {_IDLE} >= 3",
}

_DETAILS = f"""SELECT key, summary, status, status_category, priority, assignee, sprint_name, {TEAM} AS team,
  reported_sp, CAST(i.created AS DATE) AS created_date, {_label('i.created')} AS week_label,
  last_day AS completed_date, updated
FROM issues i LEFT JOIN (SELECT issue_key, CAST(max(created) AS DATE) AS last_day FROM closings GROUP BY 1)
  ON issue_key = key"""
_ACTIVE = f"""SELECT {_LIST}, flagged, CAST(created AS DATE) AS created_date, {_UPDATED},
  {_IDLE} AS days_since_update, {_URGENT} AS is_high_priority, completed_date
FROM running LEFT JOIN completed ON issue_key = key WHERE state = 'active'"""
_SCORED = f"""SELECT issue_key,
  CASE WHEN contains(prompt, '緊急') THEN 'Analysis failed: urgent tickets are not scored'
       ELSE 'length=' || length(prompt) END AS complexity_reasoning,
  CASE WHEN NOT contains(prompt, '緊急') THEN least(length(prompt), 4096) / 4096 END AS clarity_score,
  CASE WHEN NOT contains(prompt, '緊急') THEN 'by length' END AS clarity_notes,
  TIMESTAMP '{AS_OF}' AS analyzed_at
"""

BODIES: dict[str, str] = {
    # sources and ingest
    "all_issues": "SELECT * FROM described",
    "ingest_issues": f"{_INGESTED} FROM described",
    "ingest_comments": """SELECT 'c-' || key AS id, key AS issue_key, coalesce(assignee, 'Unknown') AS author,
  summary AS body, created FROM issues""",
    "ingest_changelog": """SELECT key || '_h1_' || pos AS id, key AS issue_key,
  coalesce(assignee, 'Unknown') AS author,
  CASE pos WHEN 0 THEN 'status' ELSE 'Sprint' END AS field,
  CASE pos WHEN 0 THEN 'To Do' END AS from_string,
  CASE pos WHEN 0 THEN status ELSE sprint_name END AS to_string, updated AS created
FROM (SELECT *, unnest([0, 1]) AS pos FROM issues)""",
    "sprint_list": f"""SELECT 'Main Board' AS board_name, CAST(n * 2 + odd AS INTEGER) AS sprint_id,
  {_name('n', 'odd')} AS sprint_name,
  CASE WHEN n >= 171 THEN 'future' WHEN n >= 169 THEN 'active' WHEN n >= 1 THEN 'closed' ELSE '' END AS state,
  CAST(d AS VARCHAR) AS start_date, CAST(d + 13 AS VARCHAR) AS end_date,
  CASE WHEN n < 169 THEN CAST(d + 13 AS VARCHAR) END AS complete_date
FROM (SELECT n, unnest([0, 1]) AS odd, DATE '{EPOCH}' + CAST(n * 14 AS INTEGER) AS d
      FROM (SELECT DISTINCT {_window('o_orderdate')} AS n FROM orders))""",
    "sprints_to_sync": "SELECT * FROM selected",
    "unique_sprints": "SELECT 'Second Board' AS board_name, * FROM listed",
    "sprints_to_sync_two_boards": """SELECT 'Second Board' AS board_name, sprint_id, sprint_name, state FROM listed l
WHERE state <> '' AND NOT (state = 'closed' AND EXISTS (
  SELECT 1 FROM sprints s WHERE s.sprint_id = l.sprint_id AND s.state = 'closed'))""",
    "ingest_issues_damaged": f"SELECT key, summary, updated FROM issues WHERE {_NUMBER} % 7 <> 0 AND {_NUMBER} % 11 <> 0",
    "ingest_rejects": f"""SELECT CASE WHEN {_NUMBER} % 7 = 0 THEN 'unreadable line' ELSE 'no issue key' END AS reason,
  CASE WHEN {_NUMBER} % 7 <> 0 THEN sprint_id END AS sprint_id,
  CASE WHEN {_NUMBER} % 7 = 0 THEN key END AS key
FROM issues WHERE {_NUMBER} % 7 = 0 OR {_NUMBER} % 11 = 0""",
    "future_sprint_sp_two_boards": """SELECT 2 * coalesce(SUM(reported_sp), 0) AS future_sp FROM issues
WHERE sprint_id IN (SELECT sprint_id FROM sprints WHERE state = 'future')""",
    "future_sprint_sp": """SELECT coalesce(SUM(reported_sp), 0) AS future_sp FROM issues
WHERE sprint_id IN (SELECT sprint_id FROM sprints WHERE state = 'future')""",
    "rich_text_to_plain_documents": "SELECT doc_id, text FROM documents",
    "incremental_ingest_issues": f"""{_INGESTED.replace(' priority,', ' CASE WHEN is_raised THEN ' + "'High'" + ' ELSE priority END AS priority,')},
  CAST(2 AS BIGINT) AS n_changes, CAST(1 AS BIGINT) AS n_comments
FROM raised LEFT JOIN documents ON key = 'K-' || doc_id""".replace(
        "coalesce(description, '')", "coalesce(text, '')"),
    # sinks
    "dashboard_export_counts": "\nUNION ALL ".join(
        f"SELECT '{name}' AS result, COUNT(*) AS n_rows {rows}" for name, rows in _DASHBOARD.items()),
    "dashboard_totals": "\nUNION ALL ".join(
        f"SELECT '{name}' AS result, coalesce({key}, '') AS item, CAST({count} AS DOUBLE) AS count, CAST({points} AS DOUBLE) AS points FROM {rows}"
        for name, key, count, points, rows in (
            ("leaderboard", "assignee", "issue_count", "total_sp", f"({_ranking('issues')})"), ("teamSummary", "team", "total_issues", "done_sp", "teams"),
            ("statusBreakdown", "status_category", "count", "sp",
             "(SELECT status_category, COUNT(*) AS count, round(SUM(reported_sp), 1) AS sp FROM issues GROUP BY 1)"),
            ("assigneeLoad", "assignee", "done_count", "total_sp", "load"))),
    "dashboard_export_velocity": "SELECT * REPLACE (CAST(week_start AS VARCHAR) AS week_start) FROM velocity",
    "dashboard_export_issues": f"""SELECT * REPLACE (CAST(created_date AS VARCHAR) AS created_date,
  CAST(completed_date AS VARCHAR) AS completed_date, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated)
FROM ({_DETAILS})""",
    "dashboard_export_active_issues": f"""SELECT * REPLACE (CAST(created_date AS VARCHAR) AS created_date,
  CAST(updated_date AS VARCHAR) AS updated_date, CAST(completed_date AS VARCHAR) AS completed_date)
FROM ({_ACTIVE})""",
    "csv_export_velocity": "SELECT * FROM velocity",
    "csv_export_individual": "SELECT * FROM individual",
    "csv_export_issues": _DETAILS,
    # table maintenance
    "upsert": f"""SELECT * FROM issues WHERE updated >= '{WATERMARK}'
UNION ALL BY NAME
SELECT * REPLACE ('To Do' AS status, 'To Do' AS status_category) FROM issues
WHERE created < '{WATERMARK}' AND updated < '{WATERMARK}'""",
    "replace_columns": f"""SELECT m.sprint_id, upper(m.sprint_name) AS sprint_name, m.start_date,
  CAST(NULL AS VARCHAR) AS end_date,
  CASE WHEN s.state = 'closed' THEN m.created_at ELSE TIMESTAMP '{AS_OF}' END AS created_at,
  TIMESTAMP '{AS_OF}' AS updated_at
FROM metadata m JOIN sprints s ON s.sprint_id = m.sprint_id""",
    "insert_ignore": """SELECT sprint_name, key AS issue_key FROM issues WHERE sprint_name IS NOT NULL
UNION
SELECT unnest(string_split(to_string, ', ')), issue_key FROM changelog WHERE field = 'Sprint'""",
    "recalculate_priorities": """SELECT key, summary, issuetype,
  CASE WHEN is_raised THEN 'High' ELSE priority END AS priority FROM raised""",
    "priority_changes": "SELECT COUNT(*) AS changed FROM raised WHERE is_raised",
    "create_snapshots": _snapshots(
        "s.planned_sp_snapshot IS NULL", "t.planned_sp",
        "(SELECT sprint_id, SUM(reported_sp) AS planned_sp FROM issues GROUP BY 1) t ON t.sprint_id = s.sprint_id"),
    "create_snapshots_rejects": """SELECT s.sprint_id, SUM(i.reported_sp) AS planned_sp,
  'Snapshot already exists for sprint ' || s.sprint_id AS reason
FROM sprints s JOIN issues i ON i.sprint_id = s.sprint_id
WHERE s.planned_sp_snapshot IS NOT NULL GROUP BY s.sprint_id""",
    "weekly_metrics": "SELECT * FROM weekly",
    "weekly_metrics_incremental": "SELECT * FROM weekly",
    "sprint_issues": "SELECT * FROM bridge",
    "sprint_issues_incremental": "SELECT * FROM bridge",
    "completions_incremental": """SELECT issue_key, CAST(min(created) AS DATE) AS completed_date,
  CAST(max(created) AS DATE) AS last_completed_date FROM closings GROUP BY issue_key""",
    "split_sprint_names": """SELECT id, CAST(len(parts) AS INTEGER) AS n_names, array_to_string(parts, '|') AS names
FROM (SELECT id, list_filter(list_transform(string_split(coalesce(to_string, ''), ', '), lambda p: trim(p)),
                             lambda p: p <> '') AS parts FROM changelog)""",
    "evolve_schema": """SELECT * REPLACE ('' AS issuetype, false AS flagged), CAST(NULL AS VARCHAR) AS description
FROM issues""",
    "transition_snapshots": _snapshots(
        "s.state = 'future' AND s.planned_sp_snapshot IS NULL", "coalesce(t.total_sp, 0)",
        "sprint_totals t ON t.sprint_name = s.sprint_name", state=_MOVED.replace("state", "s.state")),
    "backfill_snapshots": _snapshots(
        "s.state IN ('active', 'closed') AND s.planned_sp_snapshot IS NULL", "coalesce(t.total_sp, 0)",
        "sprint_totals t ON t.sprint_name = s.sprint_name"),
    "snapshot_coverage": """SELECT COUNT(planned_sp_snapshot) AS snapshots,
  COUNT(*) FILTER (state <> 'future') AS active_or_closed,
  COUNT(*) FILTER (state <> 'future') - COUNT(planned_sp_snapshot) AS missing,
  (SELECT COUNT(*) FROM metadata) AS metadata_records FROM sprints""",
    "run_log": "SELECT * FROM log",
    "sync_summary": """SELECT CAST(SUM(issues) AS BIGINT) AS issues, CAST(SUM(comments) AS BIGINT) AS comments,
  COUNT(*) FILTER (outcome = 'skipped') AS skipped, COUNT(*) FILTER (outcome = 'error') AS errors FROM log""",
    "sufficiency_update": f"""SELECT * FROM history WHERE snapshot_date <> DATE '{AS_OF}'
UNION ALL
SELECT DATE '{AS_OF}', future_sp, avg_velocity,
  CASE WHEN avg_velocity > 0 THEN future_sp / avg_velocity * 100 ELSE 0 END FROM future, (FROM velocity3)""",
    # column expressions
    "team_of": f"SELECT key, {TEAM} AS team FROM issues i",
    "first_completed": "SELECT * FROM completed",
    "last_completed": "SELECT issue_key, CAST(max(created) AS DATE) AS completed_date FROM closings GROUP BY issue_key",
    "iso_week_label": f"SELECT key, {_label('created')} AS week_label FROM issues",
    "week_start": f"SELECT key, {_week('created')} AS week_start FROM issues",
    "other_sprint_count": """SELECT sprint_name, issue_key,
  COUNT(*) OVER (PARTITION BY issue_key) - 1 AS other_sprint_count FROM bridge""",
    "is_high_priority": f"SELECT key, {_URGENT} AS is_high_priority FROM issues",
    "days_since_update": f"SELECT key, {_IDLE} AS days FROM issues",
    "sum_if_count_if": """SELECT board_name,
  coalesce(SUM(reported_sp) FILTER (status_category = '完了'), 0) AS done_sp,
  COUNT(*) FILTER (status_category = '完了') AS done_issues FROM issues GROUP BY board_name""",
    "safe_pct": """SELECT sprint_id, round(SUM(reported_sp)
  / nullif(coalesce(SUM(reported_sp) FILTER (status_category = 'To Do'), 0), 0) * 100, 1) AS pct
FROM issues GROUP BY sprint_id""",
    "priority_rank": f"""SELECT key,
  CAST(coalesce(list_position(['Highest', 'High', 'Medium', 'Low', 'Lowest'], priority), 6) AS INTEGER) AS rank,
  CASE WHEN priority = 'Highest' THEN 1 WHEN priority = 'High' OR {_any('summary', '優先', '緊急')} THEN 2
       ELSE 3 END AS list_rank,
  CASE priority WHEN 'Highest' THEN 1 WHEN 'High' THEN 2 ELSE 3 END AS urgency_rank FROM issues""",
    "issue_filter": f"""SELECT key, created FROM issues i
WHERE {TEAM} = 'B Scrum' AND board_name = 'Main Board' AND created >= '1997-06-01'""",
    "needs_attention": f"SELECT key FROM issues WHERE {_ATTENTION}",
    "planned_value": """SELECT s.sprint_id, coalesce(s.planned_sp_snapshot, t.total_sp) AS planned_sp
FROM sprints s LEFT JOIN sprint_totals t ON t.sprint_name = s.sprint_name""",
    # reports
    "issues_with_scores": """SELECT d.*, s.complexity_reasoning, s.clarity_score, s.clarity_notes
FROM described d LEFT JOIN scores s ON s.issue_key = d.key""",
    "leaderboard": _ranking("issues"),
    "leaderboard_main_board": _ranking("issues", "board_name = 'Main Board' AND created >= '1998-01-01'"),
    "leaderboard_last_week": _recent_ranking(0, "true"),
    "leaderboard_last_3_weeks": _recent_ranking(2, "board_name = 'Main Board'"),
    "weekly_board_metrics": _weekly("board_name,"),
    "weekly_assignee_metrics": _weekly("assignee,", "board_name = 'AI Board'"),
    "weekly_assignee_metrics_all": _weekly("assignee,"),
    "weekly_total": _weekly(),
    "latest_sufficiency": "SELECT * FROM history ORDER BY snapshot_date DESC LIMIT 1",
    "issue_count": "SELECT COUNT(*) AS issue_count FROM issues",
    "closed_sprint_ids": "SELECT sprint_id FROM sprints WHERE state = 'closed'",
    "avg_recent_velocity": "SELECT * FROM velocity3",
    "sufficiency": """SELECT future_sp, avg_velocity,
  round(CASE WHEN avg_velocity > 0 THEN future_sp / avg_velocity * 100 ELSE 0 END, 1) AS sufficiency
FROM future, (FROM velocity3)""",
    "velocity_by_team": "SELECT * FROM velocity",
    "velocity_by_team_since": """SELECT week_start, week_label, team, SUM(reported_sp) AS done_sp,
  COUNT(*) AS issue_count FROM work WHERE completed_date >= DATE '1999-03-03' GROUP BY ALL""",
    "individual_velocity": "SELECT * FROM individual",
    "team_summary": "SELECT * FROM teams",
    "recent_velocity_trend": "SELECT * FROM recent",
    "active_sprints_progress": "SELECT * FROM progress",
    "assignee_load": "SELECT * FROM load",
    "assignee_load_team": "SELECT * FROM load WHERE team = 'A Scrum'",
    "status_breakdown": """SELECT status_category, COUNT(*) AS count, round(SUM(reported_sp), 1) AS sp
FROM issues GROUP BY status_category""",
    "priority_breakdown": f"""SELECT priority, COUNT(*) AS count, round(SUM(reported_sp), 1) AS sp
FROM issues i WHERE {TEAM} = 'B Scrum' AND created >= '1996-01-01' GROUP BY priority""",
    "priority_breakdown_all": """SELECT priority, COUNT(*) AS count, round(SUM(reported_sp), 1) AS sp
FROM issues GROUP BY priority""",
    "issues_table": _DETAILS,
    "sprint_achievement": "SELECT * FROM achievement",
    "sprint_achievement_team": "SELECT * FROM achievement WHERE team = 'B Scrum'",
    "sprint_achievement_timeline": "SELECT * FROM timeline",
    "sprint_registry": """SELECT s.sprint_id, s.sprint_name, s.board_name, s.state, s.planned_sp_snapshot,
  s.snapshot_created_at, m.start_date, m.end_date, m.created_at, m.updated_at
FROM sprints s LEFT JOIN metadata m ON m.sprint_id = s.sprint_id""",
    "sprint_total_sp": """SELECT b.sprint_name, SUM(i.reported_sp) AS total_sp
FROM bridge b JOIN issues i ON i.key = b.issue_key GROUP BY b.sprint_name""",
    "sprint_total_sp_partly_stored": """SELECT b.sprint_name, coalesce(SUM(i.reported_sp), 0) AS total_sp
FROM bridge b LEFT JOIN issues i ON i.key = b.issue_key AND i.created < '1998-01-01' GROUP BY b.sprint_name""",
    "active_sprint_details": f"""SELECT r.sprint_id, r.sprint_name, r.team, r.state, m.start_date, m.end_date, {_COUNTS}
FROM running r LEFT JOIN metadata m ON m.sprint_id = r.sprint_id WHERE r.state = 'active' GROUP BY ALL""",
    "active_sprint_issues": _ACTIVE,
    "sprint_daily_burndown": """SELECT sprint_name, team, CAST(c.created AS DATE) AS completion_date,
  SUM(reported_sp) AS completed_sp, COUNT(*) AS completed_count
FROM running JOIN closings c ON c.issue_key = key WHERE state = 'active' GROUP BY ALL""",
    "sprint_member_workload": f"""SELECT sprint_name, team, assignee, {_COUNTS}
FROM running WHERE state = 'active' AND assignee IS NOT NULL GROUP BY ALL""",
    "high_priority_issues": f"""SELECT {_LIST}, flagged, {_UPDATED}, {_IDLE} AS days_since_update
FROM running WHERE state = 'active' AND {_ATTENTION}""",
    "stalled_issues": f"""SELECT {_LIST}, {_UPDATED}, {_IDLE} AS days_since_update
FROM running WHERE state = 'active' AND status_category <> '完了' AND {_IDLE} >= 3""",
    # derived metrics
    "overall_kpis": """SELECT SUM(total_sp) AS total_sp, SUM(done_sp) AS done_sp,
  round(SUM(done_sp) / SUM(total_sp) * 100, 1) AS completion_pct,
  CAST(SUM(total_issues) AS BIGINT) AS total_issues,
  (SELECT avg(sp) FROM (SELECT SUM(done_sp) AS sp FROM velocity GROUP BY week_start)) AS avg_weekly_velocity
FROM teams""",
    "trend_class": """SELECT *, CASE WHEN change_pct > 5 THEN 'improving' WHEN change_pct < -5 THEN 'declining'
  ELSE 'stable' END AS trend
FROM (SELECT team, COUNT(*) AS weeks, avg(done_sp) FILTER (l <= 3) AS recent_avg,
        avg(done_sp) FILTER (f <= 3) AS older_avg,
        CASE WHEN COUNT(*) >= 2 AND avg(done_sp) FILTER (f <= 3) > 0
             THEN (avg(done_sp) FILTER (l <= 3) - avg(done_sp) FILTER (f <= 3))
                  / avg(done_sp) FILTER (f <= 3) * 100 ELSE 0 END AS change_pct
      FROM (SELECT *, row_number() OVER (PARTITION BY team ORDER BY week_start) AS f,
              row_number() OVER (PARTITION BY team ORDER BY week_start DESC) AS l FROM recent)
      GROUP BY team)""",
    "week_over_week": """SELECT team, last_week, prev_week, last_sp, prev_sp, diff_sp, change_pct,
  CASE WHEN change_pct > 10 THEN 'up' WHEN change_pct < -10 THEN 'down' ELSE 'flat' END AS direction
FROM (SELECT *, CASE WHEN prev_week IS NULL THEN 0 ELSE last_sp - prev_sp END AS diff_sp,
        CASE WHEN prev_sp > 0 THEN (last_sp - prev_sp) / prev_sp * 100 ELSE 0 END AS change_pct
      FROM (SELECT team, week_start AS last_week, done_sp AS last_sp,
              lag(week_start) OVER w AS prev_week, coalesce(lag(done_sp) OVER w, 0) AS prev_sp,
              row_number() OVER (PARTITION BY team ORDER BY week_start DESC) AS l
            FROM recent WINDOW w AS (PARTITION BY team ORDER BY week_start))
      WHERE l = 1)""",
    "team_velocity_stats": "SELECT team, SUM(done_sp) AS total_sp, avg(done_sp) AS avg_sp FROM velocity GROUP BY team",
    "moving_average": """SELECT week_start, week_label, team, done_sp,
  CASE WHEN COUNT(*) OVER w = 3 THEN avg(done_sp) OVER w END AS moving_avg
FROM velocity WINDOW w AS (PARTITION BY team ORDER BY week_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "sprint_health": """SELECT *, done_pct >= 60 AS on_track FROM (
  SELECT sprint_name, team, total_sp, done_sp,
    CASE WHEN total_sp > 0 THEN round(done_sp / total_sp * 100, 1) ELSE 0 END AS done_pct
  FROM progress WHERE state = 'active')""",
    "achievement_kpis": """SELECT SUM(planned_sp) AS planned_sp, SUM(done_sp) AS done_sp,
  SUM(carryover_sp) AS carryover_sp, CAST(SUM(carryover_count) AS BIGINT) AS carryover_count,
  round(SUM(done_sp) / SUM(planned_sp) * 100, 1) AS true_rate FROM achievement""",
    "achievement_by_sprint": """SELECT sprint_name, SUM(planned_sp) AS planned_sp, SUM(done_sp) AS done_sp,
  SUM(carryover_sp) AS carryover_sp, CAST(SUM(carryover_count) AS BIGINT) AS carryover_count,
  round(avg(achievement_pct), 6) AS achievement_pct FROM achievement GROUP BY sprint_name""",
    "carryover_rate": """SELECT sprint_name, team, planned_sp, done_sp, carryover_sp, carryover_count, achievement_pct,
  round(coalesce(carryover_sp / nullif(planned_sp, 0) * 100, 0), 1) AS carryover_pct FROM achievement""",
    "load_per_member": """SELECT SUM(total_sp) AS total_sp, COUNT(DISTINCT assignee) AS members,
  SUM(total_sp) / COUNT(DISTINCT assignee) AS sp_per_member FROM load""",
    "team_load_class": """SELECT *, CASE WHEN sp_per_member >= 40 THEN 'overload' WHEN sp_per_member >= 30 THEN 'high'
  WHEN sp_per_member >= 20 THEN 'optimal' WHEN sp_per_member >= 10 THEN 'fair' ELSE 'low' END AS load_class,
  least(sp_per_member / 40 * 100, 100) AS load_pct
FROM (SELECT team, SUM(total_sp) AS total_sp, COUNT(DISTINCT assignee) AS members,
        CAST(SUM(issue_count) AS BIGINT) AS issues,
        SUM(total_sp) / COUNT(DISTINCT assignee) AS sp_per_member FROM load GROUP BY team)""",
    "status_share": """SELECT status_category, round(SUM(reported_sp), 1) AS sp,
  round(SUM(reported_sp), 1) / (SELECT SUM(reported_sp) FROM issues) * 100 AS share_pct
FROM issues GROUP BY status_category""",
    "assignee_ranking": """SELECT assignee, SUM(done_sp) AS total_sp FROM individual GROUP BY assignee
ORDER BY total_sp DESC, assignee LIMIT 20""",
    "assignee_mean_velocity": "SELECT round(avg(m), 6) AS mean_velocity FROM assignee_means",
    "team_mean_velocity": "SELECT team, round(team_mean, 6) AS team_mean FROM team_means",
    "individual_kpis": """SELECT COUNT(DISTINCT assignee) AS assignees, SUM(done_sp) AS total_sp,
  (SELECT round(avg(m), 6) FROM assignee_means) AS mean_individual_velocity,
  (SELECT round(avg(m), 6) FROM assignee_means) AS overall_mean FROM individual""",
    "assignee_comparison": f"""SELECT *, CASE WHEN diff_overall > 2 THEN 'above' WHEN diff_overall < -2 THEN 'below'
  ELSE 'near' END AS standing
FROM (SELECT p.assignee, p.team, round(weekly, 1) AS weekly_mean, round(team_mean, 1) AS team_mean,
        round(weekly - t.team_mean, 1) AS diff_team, round({_OVERALL}, 1) AS overall_mean,
        round(weekly - {_OVERALL}, 1) AS diff_overall, total_sp, issue_count
      FROM per_pair p JOIN team_means t ON t.team = p.team)""",
    "velocity_pivot": """SELECT assignee, week_label, coalesce(s.done_sp, 0) AS done_sp
FROM (SELECT DISTINCT assignee FROM individual) CROSS JOIN (SELECT DISTINCT week_label FROM individual)
LEFT JOIN (SELECT assignee, week_label, SUM(done_sp) AS done_sp FROM individual GROUP BY ALL) s USING (assignee, week_label)""",
    "velocity_pivot_some_weeks": """SELECT assignee,
  coalesce(SUM(done_sp) FILTER (week_label = '1995-W40'), 0) AS "1995-W40",
  coalesce(SUM(done_sp) FILTER (week_label = '1996-W01'), 0) AS "1996-W01",
  coalesce(SUM(done_sp) FILTER (week_label NOT IN ('1995-W40', '1996-W01')), 0) AS other
FROM individual GROUP BY assignee""",
    "weekly_by_assignee_team": """SELECT assignee, week_label, team, SUM(done_sp) AS done_sp
FROM individual GROUP BY ALL""",
    "assignee_summary": f"""SELECT assignee, p.team, total_sp, issue_count, active_weeks, w AS weekly_mean,
  round(t.team_mean, 1) AS team_mean, round(w - round(t.team_mean, 1), 1) AS diff_team,
  round({_OVERALL}, 1) AS overall_mean, round(w - {_OVERALL}, 1) AS diff_overall
FROM (SELECT *, round(total_sp / active_weeks, 1) AS w FROM per_pair) p JOIN team_means t ON t.team = p.team""",
    "period_start": """SELECT week_start, week_label, team, SUM(reported_sp) AS done_sp, COUNT(*) AS issue_count
FROM work WHERE completed_date >= DATE '2001-03-01' GROUP BY ALL""",
    "sufficiency_level": """SELECT snapshot_date, future_sp, avg_velocity, pct AS sufficiency_pct,
  CASE WHEN pct < 70 THEN 'red' WHEN pct < 100 THEN 'yellow' ELSE 'green' END AS level
FROM (SELECT *, round(sufficiency, 1) AS pct FROM history ORDER BY snapshot_date DESC LIMIT 1)""",
    # scoring
    "comment_threads": "SELECT * FROM threads",
    "comment_threads_long": "SELECT issue_key, CAST(length(thread) AS INTEGER) AS n_chars, md5(thread) AS digest FROM long_threads",
    "score_issues_long": _SCORED + "FROM long_prompts",
    "run_scoring_scores": _SCORED + """FROM prompts
UNION ALL BY NAME SELECT * FROM scores WHERE issue_key NOT IN (SELECT key FROM issues)""",
    "scoring_prompts": "SELECT * FROM prompts",
    "score_issues": _SCORED + "FROM prompts",
    "sprint_mvp": """SELECT assignee AS mvp, round(SUM(reported_sp), 1) AS total_sp FROM issues
WHERE assignee IS NOT NULL GROUP BY assignee ORDER BY total_sp DESC, assignee LIMIT 1""",
}

ORACLE: dict[str, str] = {name: with_views(body) for name, body in BODIES.items()}
