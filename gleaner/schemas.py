"""Schemas of the records that the triage operators take."""

from __future__ import annotations

_PRIOR = "merged boolean, closed_unmerged boolean, spam_labeled boolean, received_review boolean, author_followed_up boolean, repo_key string, title string"

#: what is known of an author when a change request arrives
FACTS = (
    "account_age_days long, has_bio boolean, followers long, restricted_contributions long, "
    f"prior array<struct<{_PRIOR.replace(' ', ':').replace(',:', ',')}>>, "
    "fork_to_pr_secs long, median_reply_secs long, commit_hour_entropy double, agent_email boolean, agent_trailer boolean, "
    "generation_footer boolean, concurrent_open long, network_verdict double, search_blocked boolean"
)

#: one change request with all that scoring needs
REQUEST = (
    "repo string, number long, author string, title string, body string, additions long, deletions long, changed_files long, commit_count long, "
    "author_association string, head_is_fork boolean, head_ref string, labels array<string>, diff string, paths array<string>, commit_emails array<string>, "
    f"commit_messages array<string>, commit_times array<long>, template string, detector_score double, created_at timestamp, "
    f"dossier struct<{FACTS.replace(', ', ',').replace(' ', ':')}>"
)

#: the author's public history as the code host returns it
DOSSIER_JSON = (
    "data struct<user:struct<createdAt:string,bio:string,followers:struct<totalCount:bigint>,contributionsCollection:struct<restrictedContributionsCount:bigint>,"
    "pullRequests:struct<nodes:array<struct<state:string,merged:boolean,title:string,createdAt:string,labels:struct<nodes:array<struct<name:string>>>,"
    "reviews:struct<totalCount:bigint>,comments:struct<nodes:array<struct<author:struct<login:string>,createdAt:string>>>,"
    "repository:struct<nameWithOwner:string,primaryLanguage:struct<name:string>>>>>>>"
)

#: a line of a mined corpus
RECORD = (
    "label string, source string, repo string, number long, title string, body string, author string, head_ref string, additions long, deletions long, "
    "changed_files long, created_at string, commits array<struct<email:string,message:string,date:string>>, files array<string>, diff string, dossier string, search_blocked boolean"
)

LABELS = "id string, label string, source string, author string, kind string"
PREDICTIONS = "id string, repo string, number long, score double"

WEBHOOK = (
    "action string, zen string, repository struct<full_name:string>, "
    "pull_request struct<number:bigint,node_id:string,title:string,body:string,additions:bigint,deletions:bigint,changed_files:bigint,commits:bigint,author_association:string,"
    "user:struct<login:string>,head:struct<ref:string,repo:struct<fork:boolean>>,labels:array<struct<name:string>>>, "
    "issue struct<number:bigint,pull_request:string>, comment struct<user:struct<login:string>,body:string>"
)

CONFIG = (
    "repo string, archetype string, ai_policy string, contribution_channel string, challenge boolean, dry_run boolean, score_comments boolean, "
    "threshold_label double, threshold_hold double, threshold_close double"
)
