"""Fixed values.

Specializations per family: title pattern and body terms, most specific first.

These strings decide results, so they are stated exactly and in matching order.
"""

SPECIALIZATIONS_BY_FAMILY = {
    "software": [
        "frontend",
        "backend",
        "fullstack",
        "mobile",
        "application_integration",
        "embedded_systems",
        "general_software",
    ],
    "cloud": [
        "devops_sre",
        "platform_engineering",
        "cloud_infrastructure",
        "cloud_security",
        "systems_storage",
        "finops",
        "general_cloud",
    ],
    "data": [
        "data_engineering",
        "analytics_bi",
        "data_science",
        "ml_engineering",
        "mlops",
        "database_administration",
        "general_data",
    ],
    "hris": [
        "workday",
        "successfactors",
        "oracle_hcm",
        "ukg",
        "payroll_benefits",
        "general_hris",
    ],
    "testing": [
        "test_automation",
        "manual_qa",
        "performance_testing",
        "qa_management",
        "general_testing",
    ],
    "networking": [
        "network_engineering",
        "network_operations",
        "network_security",
        "network_architecture",
        "wireless_telecom",
        "cloud_sdn",
    ],
}

LABELS = {
    "frontend": "Frontend",
    "backend": "Backend",
    "fullstack": "Full-stack",
    "mobile": "Mobile",
    "application_integration": "Application / Integration",
    "embedded_systems": "Embedded / Systems",
    "general_software": "General Software",
    "devops_sre": "DevOps / SRE",
    "platform_engineering": "Platform Engineering",
    "cloud_infrastructure": "Cloud Infrastructure",
    "cloud_security": "Cloud Security",
    "systems_storage": "Systems / Storage",
    "finops": "FinOps",
    "general_cloud": "General Cloud",
    "test_automation": "Test Automation / SDET",
    "manual_qa": "Manual & Functional QA",
    "performance_testing": "Performance & Load Testing",
    "qa_management": "QA Lead / Management",
    "general_testing": "General QA & Testing",
    "network_engineering": "Network Engineering",
    "network_operations": "Network Operations / NOC",
    "network_security": "Network Security",
    "network_architecture": "Network Architecture",
    "wireless_telecom": "Wireless & Telecom",
    "cloud_sdn": "Cloud & SDN Networking",
    "data_engineering": "Data Engineering",
    "analytics_bi": "Analytics / BI",
    "data_science": "Data Science",
    "ml_engineering": "Machine Learning Engineering",
    "mlops": "MLOps",
    "database_administration": "Database Administration",
    "general_data": "General Data",
    "workday": "Workday",
    "successfactors": "SuccessFactors",
    "oracle_hcm": "Oracle HCM / PeopleSoft",
    "ukg": "UKG / Kronos",
    "payroll_benefits": "Payroll / Benefits Systems",
    "general_hris": "General HRIS",
}

# family -> ordered (specialization, title pattern, body terms)
RULES = {
    "software": [
        (
            "embedded_systems",
            r"\b(embedded|firmware|rtos|device driver|bare metal|kernel (engineer|developer)|bsp|hardware software|systems programm|robotics (software|engineer))\b",
            [
                r"\bfreertos\b",
                r"\bzephyr\b",
                r"\bmicrocontroller",
                r"\bi2c\b",
                r"\bcan bus\b",
                r"\bembedded (c|linux)\b",
                r"\bfirmware\b",
                r"\breal time operating system\b",
            ],
        ),
        (
            "mobile",
            r"\b(mobile|ios|android|react native|flutter|swiftui|swift (developer|engineer)|objective c|kotlin (developer|engineer))\b",
            [
                r"\bios\b",
                r"\bandroid\b",
                r"\bswiftui\b",
                r"\bjetpack compose\b",
                r"\breact native\b",
                r"\bflutter\b",
                r"\bxcode\b",
                r"\bapp store\b",
                r"\bplay store\b",
            ],
        ),
        (
            "fullstack",
            r"\b(full ?stack)\b|\bfront ?end\b.*\bback ?end\b|\bback ?end\b.*\bfront ?end\b",
            [
                r"\bfull ?stack\b",
                r"\bend to end (feature|ownership|development)\b",
                r"\bacross the stack\b",
            ],
        ),
        (
            "frontend",
            r"\b(front ?end|ui engineer|user interface engineer|web (developer|engineer)|javascript (developer|engineer)|react (developer|engineer)|angular (developer|engineer)|vue (developer|engineer)|design engineer|ux engineer)\b",
            [
                r"\breact\b",
                r"\bangular\b",
                r"\bvue\b",
                r"\bcss\b",
                r"\btailwind\b",
                r"\bnext ?js\b",
                r"\bwebpack\b",
                r"\baccessibility\b",
                r"\bdesign system\b",
            ],
        ),
        (
            "backend",
            r"\b(back ?end|server side|api (engineer|developer)|services engineer|distributed systems|python (developer|engineer)|java (developer|engineer)|golang (developer|engineer)|net (developer|engineer)|ruby (developer|engineer)|php (developer|engineer)|node ?(js )?(developer|engineer)|scala (developer|engineer))\b",
            [
                r"\brest(ful)? api",
                r"\bgraphql\b",
                r"\bgrpc\b",
                r"\bmicroservices?\b",
                r"\bpostgres",
                r"\bdjango\b",
                r"\bspring boot\b",
                r"\bfastapi\b",
                r"\bserver side\b",
                r"\bmessage queue",
            ],
        ),
        (
            "application_integration",
            r"\b(integration (engineer|developer|specialist|analyst|architect)|middleware|mulesoft|boomi|apigee|tibco|informatica|esb|salesforce (developer|engineer)|servicenow (developer|engineer)|sap (abap|developer)|erp (developer|analyst)|applications? (developer|analyst|engineer)|solutions developer|crm developer|workflow (developer|engineer))\b",
            [
                r"\bmulesoft\b",
                r"\bboomi\b",
                r"\bapigee\b",
                r"\bsoap\b",
                r"\bmiddleware\b",
                r"\bedi\b",
                r"\bintegration platform\b",
                r"\bwebhooks?\b",
                r"\bsalesforce\b",
            ],
        ),
    ],
    "cloud": [
        (
            "cloud_security",
            r"\b(security|devsecops|infosec|cybersecurity|iam engineer|identity and access|zero trust|cspm|cnapp|siem|penetration test|appsec|vulnerability)\b",
            [
                r"\bsiem\b",
                r"\bsoc ?2\b",
                r"\bvulnerability\b",
                r"\bzero trust\b",
                r"\bpenetration test",
                r"\bfedramp\b",
                r"\bcspm\b",
                r"\bthreat (model|detection)",
                r"\biam\b",
            ],
        ),
        (
            "finops",
            r"\b(finops|cloud (cost|financial|economics)|cost optimi[sz]ation|cloud spend)\b",
            [
                r"\bfinops\b",
                r"\breserved instances?\b",
                r"\bsavings plans?\b",
                r"\bcost allocation\b",
                r"\bshowback\b",
                r"\bchargeback\b",
                r"\bunit economics\b",
            ],
        ),
        (
            "devops_sre",
            r"\b(devops|sre|site reliability|production engineer|release engineer|build engineer|reliability engineer|continuous (integration|delivery)|ci ?cd)\b",
            [
                r"\bon call\b",
                r"\bslo\b",
                r"\bsli\b",
                r"\berror budget\b",
                r"\bincident (response|management)\b",
                r"\bjenkins\b",
                r"\bgithub actions\b",
                r"\bci ?cd\b",
                r"\bpostmortem",
            ],
        ),
        (
            "platform_engineering",
            r"\b(platform (engineer|architect|reliability|operations)|developer (platform|experience|productivity)|internal developer platform|kubernetes (engineer|architect|platform)|container platform|ml ?platform|ai infrastructure|compute platform|cloud platform)\b",
            [
                r"\bbackstage\b",
                r"\binternal developer platform\b",
                r"\bgolden path",
                r"\bself service (platform|infrastructure)",
                r"\bkubernetes operator",
                r"\bhelm\b",
                r"\bargo ?cd\b",
                r"\bcrossplane\b",
            ],
        ),
        (
            "systems_storage",
            r"\b(storage|systems? admin(istrator)?|sysadmin|linux (admin|engineer|systems)|unix (admin|engineer)|windows (admin|server|systems)|vmware|virtuali[sz]ation|backup|active directory|end user comput|citrix|hypervisor|data ?cent(er|re) (engineer|operations))\b",
            [
                r"\bnetapp\b",
                r"\bceph\b",
                r"\bstorage area network\b",
                r"\bvsphere\b",
                r"\besxi\b",
                r"\bnutanix\b",
                r"\bactive directory\b",
                r"\bzfs\b",
                r"\bfibre channel\b",
            ],
        ),
        (
            "cloud_infrastructure",
            r"\b(cloud (engineer|architect|infrastructure|operations|migration|solutions?|developer)|infrastructure (engineer|architect|operations|developer)|iaas|aws (engineer|architect)|azure (engineer|architect)|gcp (engineer|architect)|landing zone|solutions? architect)\b",
            [
                r"\bcloudformation\b",
                r"\bterraform\b",
                r"\bec2\b",
                r"\bvpc\b",
                r"\blanding zone\b",
                r"\bwell architected\b",
                r"\bcloud migration\b",
                r"\bmulti cloud\b",
            ],
        ),
    ],
    "data": [
        (
            "mlops",
            r"\b(mlops|ml ops|machine learning (ops|platform|infrastructure)|model (deployment|serving|ops)|ai ?ops)\b",
            [
                r"\bmlflow\b",
                r"\bkubeflow\b",
                r"\bsagemaker\b",
                r"\bvertex ai\b",
                r"\bfeature store\b",
                r"\bmodel registry\b",
                r"\bmodel serving\b",
                r"\bmodel monitoring\b",
            ],
        ),
        (
            "ml_engineering",
            r"\b(machine learning engineer|ml engineer|deep learning engineer|ai engineer|nlp engineer|computer vision engineer|applied (scientist|ai)|llm engineer|genai engineer|research engineer|machine learning scientist|ml scientist)\b",
            [
                r"\bpytorch\b",
                r"\btensorflow\b",
                r"\bhugging ?face\b",
                r"\bmodel training\b",
                r"\bneural network",
                r"\bfine tun",
                r"\btransformer",
                r"\bembeddings?\b",
            ],
        ),
        (
            "data_science",
            r"\b(data scientist|data science|research scientist|decision scientist|quantitative (analyst|researcher)|statistician|experimentation (scientist|analyst))\b",
            [
                r"\bhypothesis test",
                r"\ba b test",
                r"\bregression\b",
                r"\bstatistical model",
                r"\bcausal infer",
                r"\bexperimentation\b",
                r"\bscikit ?learn\b",
            ],
        ),
        (
            "database_administration",
            r"\b(database (administrator|admin|engineer|architect|developer|reliability)|dba|sql server (dba|administrator)|oracle dba|postgres(ql)? (dba|administrator)|mysql dba)\b",
            [
                r"\bindex tuning\b",
                r"\bquery optimi[sz]ation\b",
                r"\breplication\b",
                r"\bhigh availability\b",
                r"\bbackup and recovery\b",
                r"\bpl sql\b",
                r"\bt sql\b",
            ],
        ),
        (
            "analytics_bi",
            r"\b(business intelligence|bi (developer|analyst|engineer|consultant)|analytics (engineer|analyst|manager|consultant)|data analyst|reporting analyst|insights analyst|tableau|power ?bi|looker|dashboard (developer|analyst)|marketing analyst|product analyst)\b",
            [
                r"\btableau\b",
                r"\bpower ?bi\b",
                r"\blooker\b",
                r"\bdashboards?\b",
                r"\bkpis?\b",
                r"\bbusiness intelligence\b",
                r"\bself service reporting\b",
                r"\bqlik\b",
            ],
        ),
        (
            "data_engineering",
            r"\b(data engineer|etl (developer|engineer)|elt (developer|engineer)|data platform|data warehouse|data pipeline|big data|data infrastructure|data architect|data ?ops)\b",
            [
                r"\bairflow\b",
                r"\bdbt\b",
                r"\bspark\b",
                r"\bsnowflake\b",
                r"\bdatabricks\b",
                r"\bkafka\b",
                r"\betl\b",
                r"\bdata pipelines?\b",
                r"\bredshift\b",
                r"\bbigquery\b",
            ],
        ),
    ],
    "hris": [
        (
            "workday",
            r"\bworkday\b",
            [
                r"\bworkday\b",
                r"\bworkday studio\b",
                r"\bcalculated fields?\b",
                r"\bworkday report",
                r"\beib\b",
            ],
        ),
        (
            "successfactors",
            r"\b(successfactors|sap sf|employee central)\b",
            [
                r"\bsuccessfactors\b",
                r"\bemployee central\b",
                r"\bsap sf\b",
                r"\bmdf\b",
            ],
        ),
        (
            "oracle_hcm",
            r"\b(peoplesoft|oracle hcm|oracle hr|fusion hcm|taleo|oracle cloud hcm)\b",
            [
                r"\bpeoplesoft\b",
                r"\boracle hcm\b",
                r"\bfusion hcm\b",
                r"\btaleo\b",
                r"\bpeoplecode\b",
            ],
        ),
        (
            "ukg",
            r"\b(ukg|ultipro|kronos|ultimate software|workforce (central|dimensions))\b",
            [
                r"\bukg\b",
                r"\bultipro\b",
                r"\bkronos\b",
                r"\bworkforce central\b",
                r"\bworkforce dimensions\b",
            ],
        ),
        (
            "payroll_benefits",
            r"\b(payroll|benefits|compensation|total rewards|adp|paycom|paylocity|paychex|ceridian|dayforce|absence management|time and attendance)\b",
            [
                r"\bpayroll\b",
                r"\bopen enrollment\b",
                r"\bbenefits administration\b",
                r"\bgarnishments?\b",
                r"\bgross to net\b",
                r"\btax filing\b",
            ],
        ),
    ],
    "testing": [
        (
            "test_automation",
            r"\b(sdet|software (development )?engineer in test|test automation|automation (engineer|developer) in test|qa automation|automation qa|automation tester)\b",
            [
                r"\bselenium\b",
                r"\bcypress\b",
                r"\bplaywright\b",
                r"\bappium\b",
                r"\bwebdriver\b",
                r"\btest automation\b",
                r"\bcucumber\b",
                r"\brest assured\b",
                r"\btestng\b",
                r"\bframework\b",
            ],
        ),
        (
            "performance_testing",
            r"\b(performance (test|testing) engineer|performance tester|load (test|testing) engineer|stress test)\b",
            [
                r"\bjmeter\b",
                r"\bgatling\b",
                r"\bloadrunner\b",
                r"\bk6\b",
                r"\bload test\b",
                r"\bthroughput\b",
                r"\blatency\b",
                r"\bstress test\b",
            ],
        ),
        (
            "qa_management",
            r"\b(qa (lead|manager|director|head)|test (lead|manager|director)|quality assurance (lead|manager|director)|head of (qa|quality|test))\b",
            [
                r"\btest strategy\b",
                r"\bquality strategy\b",
                r"\bmentor",
                r"\broadmap\b",
                r"\bstakeholder",
            ],
        ),
        (
            "manual_qa",
            r"\b(manual (qa|test|tester)|functional (qa|test|tester)|qa analyst|test analyst|game tester|software tester|qa tester)\b",
            [
                r"\btest case",
                r"\btest plan",
                r"\bregression test",
                r"\bdefect\b",
                r"\bbug (report|tracking)",
                r"\bjira\b",
                r"\bexploratory test",
            ],
        ),
    ],
    "networking": [
        (
            "network_security",
            r"\b(network security|firewall|palo alto|fortinet|zero trust network|nac engineer|network access control)\b",
            [
                r"\bfirewall\b",
                r"\bpalo alto\b",
                r"\bfortinet\b",
                r"\bcheck ?point\b",
                r"\bids\b",
                r"\bips\b",
                r"\bvpn\b",
                r"\bsegmentation\b",
                r"\bzero trust\b",
            ],
        ),
        (
            "cloud_sdn",
            r"\b(sd[-\s]?wan|\bsdn\b|cloud network|network automation|cisco aci|\bnsx\b|viptela|meraki)\b",
            [
                r"\bsd ?wan\b",
                r"\bsdn\b",
                r"\baci\b",
                r"\bnsx\b",
                r"\bterraform\b",
                r"\btransit gateway\b",
                r"\bmeraki\b",
                r"\bnetwork automation\b",
                r"\bansible\b",
            ],
        ),
        (
            "wireless_telecom",
            r"\b(wireless|wi[-\s]?fi|rf engineer|\b5g\b|\blte\b|telecom|voip|voice (network )?engineer|unified communications|\bsip\b)\b",
            [
                r"\bwi ?fi\b",
                r"\baccess point",
                r"\bruckus\b",
                r"\baruba\b",
                r"\b802\.11\b",
                r"\bsip\b",
                r"\bvoip\b",
                r"\b5g\b",
                r"\blte\b",
                r"\bran\b",
            ],
        ),
        (
            "network_operations",
            r"\b(noc|network operations)\b",
            [
                r"\bmonitoring\b",
                r"\bincident\b",
                r"\bticket",
                r"\bescalation\b",
                r"\buptime\b",
                r"\bon call\b",
            ],
        ),
        (
            "network_architecture",
            r"\b(network architect|principal network|enterprise network architect|network design engineer)\b",
            [
                r"\btopology\b",
                r"\bnetwork design\b",
                r"\bcapacity planning\b",
                r"\bhigh availability\b",
            ],
        ),
    ],
}

GENERIC_TITLE = {
    "software": r"\b(software (engineer|developer|development engineer)|sde|programmer|member of technical staff|software architect|engineer (i|ii|iii|iv|v|[1-5])|forward deployed engineer|ai engineer|applied ai|llm engineer|genai engineer|agentic ai|product engineer)\b",
    "cloud": r"\b(cloud engineer|infrastructure engineer|systems engineer|it (engineer|operations)|technical operations|operations engineer)\b",
    "data": r"\b(data (specialist|professional|associate|consultant)|analytics (specialist|professional))\b",
    "hris": r"\b(hris|hcm|hrms|hr (systems|technology|information)|people (systems|technology)|human resources (information|systems))\b",
    "testing": r"\b(qa engineer|q a engineer|quality assurance( engineer| analyst| specialist)?|quality engineer|test engineer|tester|software test(ing)? engineer|\bqa\b)\b",
    "networking": r"\b(network engineer|network administrator|network analyst|network technician|network specialist|network consultant|network support|networking engineer|routing and switching)\b",
}

GENERAL = {
    "software": "general_software",
    "cloud": "general_cloud",
    "data": "general_data",
    "hris": "general_hris",
    "testing": "general_testing",
    "networking": "network_engineering",
}

FAMILY_NOUN = {
    "software": "Software",
    "cloud": "Cloud",
    "data": "Data",
    "hris": "HRIS",
    "testing": "Testing",
    "networking": "Networking",
}

CLASSIFICATION_VERSION = "spec-2"
MIN_BODY_HITS = 2
BODY_MARGIN = 2
