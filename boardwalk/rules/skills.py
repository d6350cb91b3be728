"""Fixed values.

Skill vocabularies: (pattern, canonical name, weight), one list per family.

These strings decide results, so they are stated exactly and in matching order.
"""

CLOUD_SKILLS = [
    (r"\b(aws|amazon web services)\b", "AWS", 3),
    (r"\b(azure|microsoft azure)\b", "Azure", 3),
    (r"\b(gcp|google cloud)\b", "GCP", 3),
    (r"\b(oci|oracle cloud)\b", "OCI", 3),
    (r"\b(kubernetes|k8s|eks|aks|gke|openshift)\b", "Kubernetes", 4),
    (r"\bterraform\b", "Terraform", 4),
    (r"\b(cloudformation|pulumi|bicep)\b", "IaC", 3),
    (r"\b(ansible|puppet|chef|saltstack)\b", "Config Mgmt", 3),
    (r"\b(docker|containerd|podman)\b", "Docker", 2),
    (r"\bhelm\b", "Helm", 3),
    (r"\b(argo\s?cd|argocd|flux\s?cd|gitops)\b", "GitOps", 3),
    (r"\bci/?cd\b", "CI/CD", 2),
    (r"\b(jenkins|gitlab ci|github actions|circleci|teamcity)\b", "CI Tooling", 2),
    (r"\b(prometheus|grafana|datadog|splunk|new relic|opentelemetry|nagios|zabbix)\b", "Observability", 3),
    (r"\b(linux|unix|rhel|centos)\b", "Linux", 2),
    (r"\b(bash|shell scripting|powershell)\b", "Scripting", 1),
    (r"\b(vpc|subnet|bgp|ospf|load balanc|firewall|\bvpn\b|tcp/ip)\b", "Networking", 2),
    (r"\b(vmware|vsphere|esxi|hyper-v|nutanix|citrix)\b", "Virtualization", 3),
    (r"\b(storage area network|network attached storage|ceph|netapp|storage array|iscsi|fibre channel)\b", "Storage", 3),
    (r"\b(devsecops|cspm|cnapp|soc ?2|fedramp|cis benchmark)\b", "Cloud Security", 3),
    (r"\b(active directory|group policy|windows server|sccm|intune)\b", "Windows/AD", 2),
    (r"\b(finops|cloud cost|reserved instances?)\b", "FinOps", 3),
]

SOFTWARE_SKILLS = [
    (r"\bpython\b", "Python", 3),
    (r"\b(django|flask|fastapi|pyramid|celery|drf|django rest)\b", "Python Web", 4),
    (r"\b(pytest|asyncio|sqlalchemy|pydantic|poetry|boto3|streamlit|pyspark|tox|uvicorn|gunicorn)\b", "Python Tooling", 3),
    (r"\b(typescript|javascript|node\.?js|nodejs)\b", "JS/TS", 3),
    (r"\b(react|next\.?js|vue|angular|svelte)\b", "Frontend FW", 3),
    (r"\b(java|spring boot|spring)\b", "Java", 2),
    (r"(\bgolang\b|\.net\b|c#|\bruby on rails\b|\brails\b|\bphp\b|\blaravel\b|\bkotlin\b|\bscala\b|\brust\b|\belixir\b)", "Other Backend", 2),
    (r"\b(rest api|restful|graphql|grpc|microservices?)\b", "APIs", 2),
    (r"\b(postgres(ql)?|mysql|mongodb|redis|dynamodb)\b", "Databases", 2),
    (r"\b(html|css|tailwind|sass)\b", "Web UI", 1),
    (r"\b(unit test|pytest|jest|tdd|test[- ]driven)\b", "Testing", 1),
    (r"\b(langchain|langgraph|llamaindex|crewai|openai|anthropic|rag\b|vector (db|database)|prompt engineering|fine[- ]tun(e|ing)|genai|\bllm\b)\b", "LLM Tooling", 3),
]

DATA_SKILLS = [
    (r"\bsql\b", "SQL", 3),
    (r"\b(spark|pyspark|hadoop|hive|flink)\b", "Big Data", 4),
    (r"\b(airflow|dagster|prefect|luigi)\b", "Orchestration", 4),
    (r"\bdbt\b", "dbt", 4),
    (r"\b(snowflake|databricks|redshift|bigquery|synapse)\b", "Warehouse", 4),
    (r"\b(tableau|power ?bi|looker|qlik|superset|mode analytics)\b", "BI Tools", 3),
    (r"\b(kafka|kinesis|pubsub|streaming)\b", "Streaming", 3),
    (r"\b(etl|elt|data pipeline|data warehouse|data lake|lakehouse)\b", "Pipelines", 3),
    (r"\b(pandas|numpy|scikit[- ]?learn|jupyter)\b", "Python Data", 3),
    (r"\b(tensorflow|pytorch|keras|xgboost|hugging ?face)\b", "ML Frameworks", 4),
    (r"\b(mlflow|kubeflow|sagemaker|vertex ai|feature store)\b", "MLOps", 4),
    (r"\b(statistic|regression|forecasting|a/b test|experimentation)\b", "Statistics", 2),
    (r"\b(data model(l)?ing|star schema|dimensional model)\b", "Modeling", 3),
]

HRIS_SKILLS = [
    (r"\bworkday\b", "Workday", 4),
    (r"\b(successfactors|sap sf)\b", "SuccessFactors", 4),
    (r"\b(ukg|ultipro|kronos)\b", "UKG/Kronos", 4),
    (r"\b(peoplesoft|oracle hcm|taleo)\b", "Oracle HCM", 4),
    (r"\b(dayforce|ceridian)\b", "Dayforce", 4),
    (r"\b(adp\b|paycom|paylocity|paychex|bamboohr|namely|rippling|gusto)\b", "Payroll/HRIS", 3),
    (r"\b(hris|hcm|hrms)\b", "HRIS/HCM", 4),
    (r"\b(benefits administration|open enrollment|payroll process)\b", "Benefits/Payroll", 3),
    (r"\b(core hr|absence management|time (and|&) attendance|compensation module)\b", "HR Modules", 3),
    (r"\b(applicant tracking|onboarding system|talent management system)\b", "Talent Systems", 2),
]

