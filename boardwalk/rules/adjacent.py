"""Fixed values.

Adjacent roles and the review pile: vetoes, ordered rules with a fallback family.

These strings decide results, so they are stated exactly and in matching order.
"""

from .families import HRIS_PRODUCTS

NEVER_ADJACENT = (
    r"\b(mechanical|electrical|electronics|civil|chemical|process|manufactur\w*|production|"
    r"quality|industrial|structural|aerospace|automotive|biomedical|environmental|"
    r"geotechnical|geological|mining|petroleum|drilling|welding|hvac|plumbing|marine|nuclear|"
    r"packaging|textile|food|agricultur\w*|plant|facilities|field service|construction|"
    r"survey\w*|cad|autocad|solidworks|piping|instrumentation|calibration|"
    r"maintenance technician)\b"
)

HARDWARE_ENGINEERING = (
    r"\b(battery|batteries|fuel|thermal|propulsion|avionics|air vehicles?|spacecraft|"
    r"satellite|launch|payload|airframe|flight|ground systems?|structures|mechanisms|"
    r"mechatronics|robotics|motor|powertrain|optical|optics|laser|photonics|antenna|rf|"
    r"microwave|semiconductor|silicon|wafer|asic|fpga|pcb|circuit|analog|bios|hardware|sensor|"
    r"actuator|hydraulic|pneumatic|acoustic)\b"
)

IT_SIGNAL = (
    r"\b(information (technology|systems)|linux|unix|windows|server|network|cloud|aws|azure|"
    r"gcp|infrastructure|enterprise|active directory|vmware|virtuali[sz]\w*|storage|"
    r"datacent(er|re)|sccm|intune|citrix|sql|database|erp|sap|saas|devops|kubernetes|docker|"
    r"ansible|powershell|bash|python)\b"
)

IT_ACRONYM = r"\bIT\b"

NOT_A_TECH_ROLE = (
    r"\b(security (officer|guard|specialist)|behavio(u)?r analyst|data entry|data collector|"
    r"loss prevention|dispatch|scheduler|claims|underwrit\w*|actuar\w*|nurse|pharmac\w*|"
    r"phlebotom\w*|radiolog\w*|teller|cashier|barista|server|host(ess)?)\b"
)

FORCE_ADJACENT = (
    r"\b(gtm|go[-\s]?to[-\s]?market|(solutions?|implementation|customer success|"
    r"customer reliability|technical account)\s+engineer|developer\s+(relations|advocate)|"
    r"devrel)\b"
)

RULES = [
    ("gtm", r"\b(gtm|go[-\s]?to[-\s]?market)\b", "software"),
    ("solutions_engineering", r"\b(solutions?|implementation|customer success|customer reliability|technical account)\s+engineer\b", "cloud"),
    ("devrel", r"\b(developer\s+(relations|advocate)|devrel)\b", "software"),
    ("hris_platform", HRIS_PRODUCTS, "hris"),
    ("hris_operations", r"\b(payroll|benefits|total rewards|compensation)\b", "hris"),
    ("technical_pm", r"\btechnical\s+(program|project|product|delivery|engagement)\s+manager\b", "software"),
    ("business_analysis", r"\b(business\s+(systems\s+)?analyst|business\s+intelligence|systems\s+analyst|data\s+analyst|reporting\s+analyst|product\s+analyst|marketing\s+analyst|operations\s+analyst|process\s+analyst|integration\s+analyst|enterprise\s+architecture\s+analyst)\b", "data"),
    ("systems_engineering", r"\b(systems?\s+engineer|systems?\s+specialist|infrastructure\s+specialist)\b", "cloud"),
    ("technical_support", r"\b(technical\s+support|support\s+engineer|application\s+support|production\s+support|escalation\s+engineer|customer\s+reliability)\b", "cloud"),
    ("test_automation", r"\b(test\s+engineer|automation\s+engineer|test\s+automation|validation\s+engineer|\bqa\b|quality\s+assurance\s+(engineer|analyst))\b", "software"),
    ("solution_architecture", r"\b(solutions?\s+architect|enterprise\s+architect|technical\s+architect|integration\s+architect)\b", "cloud"),
    ("generic_engineering", r"^(senior|sr\.?|staff|principal|lead)?\s*(software\s+)?engineer(ing)?\s*(i{1,3}|iv|v|\d)?$|^(senior|sr\.?|staff|principal|lead)\s+engineer\b|\b(applications?\s+engineer|technical\s+specialist|technology\s+specialist)\b", "software"),
]

NEVER_UNSORTED = (
    r"\b(mechanical|electrical|electronics|civil|chemical|process|manufactur\w*|production|"
    r"quality|industrial|structural|aerospace|automotive|biomedical|environmental|"
    r"geotechnical|mining|petroleum|drilling|welding|hvac|plumbing|marine|nuclear|packaging|"
    r"plant|facilities|field service|construction|highway|survey\w*|maintenance)\b"
)

PHYSICAL_SECURITY = (
    r"\b(security\s+(officers?|guards?|supervisors?|site\s+lead|manager|managers|patrol|"
    r"screening|licen[cs]e)|event\s+security|crowd\s+control|loss\s+prevention|"
    r"door\s+supervisor|close\s+protection)\b"
)

NOT_OUR_WORLD = (
    r"\b(nurse|nursing|clinical|physician|pharmac\w*|dental|veterinar\w*|therapist|teacher|"
    r"lecturer|professor|chef|cook|barista|cashier|waiter|waitress|driver|warehouse|forklift|"
    r"janitor|custodian|cleaner|labour\w*|farm|retail\s+associate|store\s+manager)\b"
)

LOOKS_TECHNICAL = (
    r"\b(engineer|engineering|developer|architect|administrator|programmer|analyst|scientist|"
    r"technical|technology|systems?|software|cloud|azure|aws|gcp|platform|infrastructure|"
    r"network|database|integration|automation|devops|sre|\bit\b|digital|application|api|web|"
    r"mobile|\bqa\b|test|cyber|forensics|erp|crm|saas|salesforce|dynamics|sharepoint|"
    r"power\s+platform)\b"
)

