"""Schemas of landed pages and details, of postings, and of the run, change and history tables."""

from __future__ import annotations

SUMMARY = "id string, name string, displayJobId string, department string, workLocationOption string, locations array<string>, standardizedLocations array<string>, postedTs long, creationTs long, isHot boolean"
PAGE = f"pass int, page int, total long, sortBy string, positions array<struct<{SUMMARY.replace(' ', ':').replace(',:', ',')}>>"
DETAIL = "id string, name string, displayJobId string, department string, publicUrl string, jobDescription string, profession array<string>, discipline array<string>, roleType array<string>, employmentType array<string>, workSite array<string>, travel array<string>, locations array<string>, standardizedLocations array<string>"
POSTING = (
    "id string, jobId string, title string, department string, profession string, discipline string, roleType string, employmentType string, workSite string, travel string, seniority string, archetype string, workLocationOption string, url string, "
    "org string, orgSource string, degree string, overview string, descriptionHash string, descriptionHtml string, status string, locations array<string>, countryCodes array<string>, themes array<string>, industries array<string>, products array<string>, "
    "solutionAreas array<string>, initiatives array<string>, skills array<string>, postedTs long, creationTs long, requiredYears int, isHot boolean, hasQualifications boolean, hasDetail boolean, firstSeenAt timestamp, lastSeenAt timestamp, detailFetchedAt timestamp, closedAt timestamp, daysOpen long"
)
RUN = "status string, date string, startedAt timestamp, finishedAt timestamp, mode string, openCount long, missingDetail long, searchErrors long, detailErrors long, added long, removed long, updated long"
CHANGE = "finishedAt timestamp, kind string, id string, field string, before string, after string"
HISTORY = "date string, at timestamp, totalOpen long, added long, removed long, updated long, themes map<string,long>, professions map<string,long>, orgs map<string,long>"
