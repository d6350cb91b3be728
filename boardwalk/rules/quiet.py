"""Fixed values.

Titles the crowd searches for, and boards every aggregator republishes.

These strings decide results, so they are stated exactly and in matching order.
"""

MAGNET_TITLES = [
    "software engineer",
    "software developer",
    "software development engineer",
    "full stack engineer",
    "full stack developer",
    "fullstack engineer",
    "backend engineer",
    "back end engineer",
    "backend developer",
    "frontend engineer",
    "front end engineer",
    "frontend developer",
    "front end developer",
    "web developer",
    "mobile engineer",
    "ios engineer",
    "android engineer",
    "engineering manager",
    "devops engineer",
    "devops",
    "cloud engineer",
    "cloud architect",
    "site reliability engineer",
    "platform engineer",
    "infrastructure engineer",
    "network engineer",
    "security engineer",
    "solutions architect",
    "solution architect",
    "solutions engineer",
    "systems engineer",
    "data engineer",
    "data scientist",
    "data analyst",
    "business analyst",
    "analytics engineer",
    "machine learning engineer",
    "business intelligence analyst",
    "data architect",
    "ai engineer",
    "ml engineer",
    "aiml engineer",
    "workday analyst",
    "workday consultant",
    "hris analyst",
    "hris manager",
    "payroll specialist",
    "payroll manager",
    "hr analyst",
]

MAGNET_ACRONYMS = ["sre", "sdet", "swe"]

SYNDICATED_PROVIDERS = ["greenhouse", "lever", "ashby"]
