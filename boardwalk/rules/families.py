"""Fixed values.

Title patterns and exclusions that decide a role family.

These strings decide results, so they are stated exactly and in matching order.
"""

from . import Rule

NOT_INFOSEC = (
    r"\b(border|physical|site|corporate|building|campus|retail|event|airport|maritime|port|"
    r"transit|guard|patrol|officer|loss prevention|surveillance)\s+security\b|"
    r"\bsecurity\s+(guard|officer|patrol|supervisor|screener)\b"
)

NOT_SOFTWARE_ARCHITECT = (
    r"\b(project|landscape|building|interior|urban|naval|safety case|functional safety|"
    r"structural|electrical|mechanical|civil|design)\s+architect\b|\barchitect\s+(of record|"
    r"intern|assistant)\b"
)

NOT_SOFTWARE_ENG_MANAGER = (
    r"\b(manufactur\w*|mechanical|electrical|civil|structural|chemical|process|plant|"
    r"production|quality|field|facilities|maintenance|regional market|construction|packaging|"
    r"automotive|aerospace)\b"
)

PRODUCTION_ENGINEER = r"\bproduction\s+engineer\b"

PRODUCTION_MANUFACTURING = (
    r"\b(mechanical|manufactur\w*|additive|assembly|fabricat\w*|machin(e|ing)|cnc|tooling|"
    r"weld\w*|casting|moulding|molding|shift|plant|factory|shop floor|lean|six sigma|"
    r"electrical|electronics|semiconductor|wafer|cleanroom|lithograph\w*|materials?|chemical|"
    r"hardware|aerospace|automotive|laser|optics?|optical|photonics|vacuum|duv|euv|robotics|"
    r"bioprocess)\b"
)

PRODUCTION_TECHNICAL = (
    r"\b(cloud|software|network|infrastructure|platform|site reliability|data|web|devops|sre|"
    r"application|bioinformatics)\b"
)

CLOUD_TITLE_NOISE = (
    r"\b(instructor|trainer|training|teacher|curriculum|academy|bootcamp|audit\w*|sourcing|"
    r"procurement|vendor manage\w*|sales|account executive|recruit\w*|equipment operator|"
    r"bridge|highway|roadway|civil|paving|seasonal|learning management)\b"
)

CLOUD_TITLES = (
    r"\b(devops|sre|site reliability|production engineer|platform engineer|"
    r"platform reliability|cloud engineer|cloud architect|solutions architect|"
    r"cloud operations|cloud infrastructure|infrastructure engineer|infrastructure architect|"
    r"systems administrator|sysadmin|devsecops|cloud security|storage engineer|"
    r"virtuali[sz]ation|build engineer|release engineer|observability|kubernetes|finops|"
    r"ml ?platform|ai infrastructure|technical operations|techops|site operations|"
    r"infra engineer|systems architect|cluster (engineer|architect)|capacity engineer|"
    r"provisioning engineer)\b|\b(systems?|sys)\s?admin\w*\b|\b(linux|unix|"
    r"aix)\s+(administrator|admin)\b|\binfrastructure\s+(engineer|developer|analyst|architect|"
    r"specialist|lead)\b|\b(cyber ?security|information security|infosec|application security|"
    r"product security|cloud security|it security|data security|platform security|"
    r"offensive security|soc)\s+(engineer|analyst|architect|specialist|consultant|lead)\b|"
    r"\bsecurity\s+(engineer|analyst|architect|consultant|lead)\b|\b(soc analyst|"
    r"penetration tester|pen tester|red team|threat (analyst|hunter)|vulnerability (analyst|"
    r"engineer)|iam engineer|identity (engineer|architect))\b|\b(cloud|azure|aws|"
    r"gcp)\s+(\w+\s+)?developer\b"
)

CLOUD_TITLES_LOOSE = (
    r"\b(cloud|aws|amazon web services|azure|gcp|google cloud|kubernetes|k8s|openshift|"
    r"terraform|vmware|datacent(er|re)|active directory)\b[^,]{0,40}\b(engineer|developer|"
    r"architect|administrator|admin|analyst|specialist|consultant|operations|sre|lead)\b|"
    r"\b(engineer|developer|architect|administrator|admin|analyst|specialist|"
    r"consultant)\b[^,]{0,40}\b(cloud|aws|azure|gcp|kubernetes|openshift|vmware)\b"
)

SOFTWARE_TITLES = (
    r"\b(software engineer|software developer|software development engineer|\bsde\b|backend|"
    r"back[- ]end|frontend|front[- ]end|full[- ]?stack|python developer|python engineer|"
    r"web developer|application developer|applications engineer|api engineer|ux engineer|"
    r"growth engineer|programmer|ai engineer|llm engineer|genai engineer|applied ai|"
    r"forward deployed engineer|developer|software architect|application architect|"
    r"technical architect|enterprise architect|ai architect|data architect|"
    r"principal architect|lead architect|engineer(ing)? manager|engineer(ing)? director|"
    r"(director|head|vp),? of engineer(ing)?)\b"
)

DATA_TITLES = (
    r"\b(data engineer|data analyst|analytics engineer|data scientist|data architect|"
    r"database engineer|database administrator|\bdba\b|etl developer|data platform|"
    r"data warehouse|big data|business intelligence|\bbi\b (developer|analyst|engineer)|"
    r"reporting analyst|machine learning engineer|ml engineer|machine learning scientist|"
    r"research scientist|quantitative analyst|decision scientist|data quality|mlops|ml ops)\b"
)

HRIS_PRODUCTS = (
    r"\b(workday|successfactors|sap ?sf|peoplesoft|oracle hcm|taleo|ukg|ultipro|kronos|"
    r"dayforce|ceridian|paycom|paylocity|paychex|bamboohr)\b"
)

HRIS_NON_HR_MODULE = (
    r"\b(financ\w*|fins?|accounting|supply chain|procurement|inventory|adaptive planning|"
    r"student|grants?|revenue)\b"
)

AI_TITLE = (
    r"\b(ai|ml|machine learning|deep learning|llm|genai|generative ai|nlp|computer vision|"
    r"mlops|data scientist)\b"
)

AI_BODY_STRONG = (
    r"\b(machine learning|deep learning|large language model|generative ai|neural network|"
    r"computer vision|natural language processing|pytorch|tensorflow|hugging ?face|"
    r"scikit[- ]?learn|mlops|fine[- ]tun(e|ing)|model (training|inference|deployment))\b"
)

ENGINEERING_ROLE = (
    r"\b(engineer|engineering|developer|architect|administrator|programmer|sre|devops|"
    r"scientist|analyst)\b"
)

HRIS_EXCLUSIONS = (
    r"\b(software engineer|software developer|backend|frontend|full[- ]?stack|devops|sre|"
    r"data engineer|product manager|designer)\b"
)

TESTING_TITLES = (
    r"\b(sdet|software (development )?engineer in test|test engineer|qa engineer|"
    r"q\.?a\.? engineer|qa analyst|qa automation( engineer)?|automation qa|"
    r"quality assurance (engineer|analyst|specialist|tester|lead|manager|automation)|"
    r"software quality (engineer|assurance)|test automation( engineer| specialist)?|"
    r"test analyst|manual (qa|test)( engineer| analyst| tester)?|manual tester|functional (qa|"
    r"test)( engineer| analyst| tester)?|performance (test|testing) engineer|"
    r"performance tester|load (test|testing) engineer|test (lead|architect|manager|director)|"
    r"qa (lead|manager|director|specialist|tester|engineer)|game tester|software tester)\b"
)

NOT_TESTING = r"\b(penetration tester|pen tester|beta tester|usability tester|material tester|hardware tester)\b"

TESTING_NONSOFTWARE = (
    r"\b(manufactur\w*|supplier|mechanical|electrical|electronic|production|assembly|"
    r"aerospace|automotive|pharmaceutical|pharma|clinical|laboratory|\blab\b|haccp|\bgmp\b|"
    r"iso ?9001|metrology|calibration|semiconductor|wafer|hardware|civil|construction|"
    r"chemical|food|beverage|welding|\bndt\b|non[-\s]destructive|flight|\bspace\b|spacecraft|"
    r"satellite|avionics|aircraft|rocket|propulsion|missile|radar|sonar|payload|drone|\buav\b|"
    r"optical|photonics|laser|robotics)\b"
)

NETWORKING_TITLES = (
    r"\b(network engineer|network administrator|network architect|network analyst|"
    r"network technician|network specialist|network consultant|network operations|"
    r"network reliability engineer|network security( engineer| analyst| architect| specialist|"
    r" administrator)|noc( engineer| analyst| technician)|\bnoc\b|routing and switching|"
    r"sd[-\s]?wan|\bsdn\b|wan engineer|lan engineer|wireless network( engineer| architect)|"
    r"wireless engineer|network automation( engineer| specialist)?|"
    r"telecom(munications)? engineer|voip engineer|voice (network )?engineer|"
    r"unified communications( engineer| administrator)|network support engineer)\b"
)

NOT_NETWORKING = (
    r"\b(social network|neural network|network marketing|professional network|"
    r"developer network|advertising network)\b"
)

NETWORKING_HARDWARE = (
    r"\b(antenna design|phased array|microwave (circuit|hardware|component)|semiconductor|"
    r"wafer|pcb (design|layout)|analog (ic|circuit)|mixed[-\s]signal|chip design|\basic\b|"
    r"\bfpga\b)\b"
)

HARD_EXCLUSIONS = [
    (r"\b(sales|account)\s+(engineer|executive|manager|director)\b", "sales"),
    (r"\bpre[- ]?sales\b", "pre-sales"),
    (r"\b(recruiter|talent acquisition|sourcer|staffing (specialist|coordinator))\b", "recruiting"),
    (r"\b(data ?cent(er|re)\s+(technician|tech|operator))\b", "datacenter hardware"),
    (r"\b(help ?desk|service desk|desktop support|field (service|technician))\b", "end-user support"),
    (r"\b(intern|internship|co[- ]?op)\b", "internship"),
    (r"\b(nurse|physician|therapist|clinician|caregiver|pharmacist|dental|veterinar)\b", "clinical"),
    (r"\b(teacher|professor|lecturer|faculty)\b", "education"),
    (r"\b(counsel|attorney|paralegal|compliance officer)\b", "legal"),
    (r"\b(evangelist|technical writer)\b", "devrel/docs"),
    (r"\b(forklift|janitor|custodian|security guard|armed guard)\b", "manual"),
    (r"\b(delivery|truck|cdl|bus|van)\s+drivers?\b", "manual"),
    (
        Rule((
            r"\bproduction\s+engineer\b",
            r"\b(mechanical|manufactur\w*|additive|assembly|fabricat\w*|machining|cnc|tooling|weld\w*|casting|moulding|molding|shop floor|six sigma|electrical|electronics|semiconductor|wafer|cleanroom|lithograph\w*|laser|optics?|photonics|vacuum|duv|euv|aerospace|automotive)\b",
        )),
        "manufacturing",
    ),
    (r"^copy of\b", "draft"),
    (r"\bdeal desk\b", "revenue"),
    (
        Rule(
            must=(r"\b(solutions?|sales|customer success|customer reliability|implementation)\s+(consultant|manager)\b",),
            must_not=(r"\b(hris|hcm|hrms|workday|successfactors|peoplesoft|ukg|dayforce|payroll|benefits)\b",),
        ),
        "customer-facing",
    ),
    (r"\bsales\b|\bbusiness develop(ment|er)\b|\b(sdr|bdr)\b|\brepresentative\b|\bquota\b", "sales"),
    (r"\b(financial analyst|finance manager|treasury|investor relations)\b", "finance"),
    (r"\b(executive assistant|office administrator|receptionist|facilities)\b", "admin"),
]

SOFT_EXCLUSIONS = [
    (r"\b(marketing|content writer|copywriter|social media|seo specialist)\b", "marketing"),
    (r"\b(accountant|accounting|controller|bookkeep)\b", "accounting"),
    (r"\blegal\b", "legal"),
    (r"\b(designer|creative director|illustrator|ux\s+(designer|researcher|writer))\b", "design"),
    (r"\b(product|program|project|procurement|sourcing|category|community|office)\s+manager\b", "non-engineering management"),
    (r"\bwarehous(e|ing)\b", "manual"),
    (r"\bdrivers?\b", "manual"),
    (r"\bgrowth (content )?engineer\b", "revenue"),
]

HRIS_SYSTEMS_WORD = (
    r"(analyst|administrator|systems?|specialist|configuration|implementation|"
    r"integration|technolog\w*|reporting|data|platform)"
)

# Any one of these makes an HR-systems title.
HRIS_TITLES = [
    r"\b(hris|hcm|hrms)\b",
    r"\b(human resources? (information|systems?)|hr (systems?|technology|information)|people (systems|technology|platform))\b",
    HRIS_PRODUCTS,
    Rule((r"\b(payroll|benefits|total rewards|compensation)\b", r"\b" + HRIS_SYSTEMS_WORD + r"\b")),
    r"\b(hr data analyst|hr operations analyst|people analytics|workforce analytics|hr reporting)\b",
]

ENGINEERING_LEADERSHIP = (
    r"\bengineer(ing)? (manager|director)\b|\b(director|head|vp),? of engineer(ing)?\b"
)

REAL_FAMILIES = ["cloud", "software", "data", "hris", "testing", "networking"]
# First matching title wins, in this order.
TITLE_ORDER = ["hris", "testing", "networking", "data", "cloud", "software"]
# Families that may be inferred from skills, in tie-breaking order.
STACK_FAMILIES = ["data", "cloud", "software"]
SKILL_THRESHOLD = 5
DOMINANCE_RATIO = 2
DOMINANCE_MARGIN = 8

PYTHON_STACK = [
    "Python", "Python Web", "Python Tooling", "Python Data",
    "LLM Tooling", "ML Frameworks", "MLOps",
]
OTHER_STACK = ["JS/TS", "Frontend FW", "Java", "Other Backend", "Web UI"]
