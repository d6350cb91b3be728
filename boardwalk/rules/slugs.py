"""Fixed values.

Company-name noise words, sector words and known short names.

These strings decide results, so they are stated exactly and in matching order.
"""

NOISE = (
    r"\b(inc|llc|ltd|limited|corp|corporation|co|company|gmbh|sa|sas|bv|plc|group|holdings|"
    r"holding|technologies|technology|tech|labs|software|systems|solutions|international|"
    r"worldwide|global|enterprises|partners|services|industries|brands|stores|america|"
    r"american|usa|us|the)\b"
)

SECTOR_WORDS = (
    r"\b(health|healthcare|financial|finance|bank|banking|energy|insurance|motor|motors|"
    r"pharmaceuticals?|medical|media|communications|electric|foods?|airlines?|air|stores?|"
    r"university)\b"
)

ALIASES = {
    "jpmorgan chase": ["jpmc", "jpmorganchase", "chase"],
    "bank of america": ["bankofamerica", "boa", "bofa"],
    "wells fargo": ["wellsfargo", "wf"],
    "unitedhealth group": ["unitedhealthgroup", "uhg", "unitedhealth"],
    "hewlett packard enterprise": ["hpe"],
    "hp inc": ["hp"],
    "general motors": ["generalmotors", "gm"],
    "general electric": ["ge", "generalelectric"],
    "general dynamics": ["gd", "generaldynamics"],
    "american express": ["amex", "americanexpress"],
    "lockheed martin": ["lockheedmartin", "lmco"],
    "northrop grumman": ["northropgrumman", "ngc"],
    "booz allen hamilton": ["boozallen", "bah"],
    "caci international": ["caci"],
    "l3harris": ["l3harris", "harris"],
    "huntington ingalls": ["hii", "huntingtoningalls"],
    "exxon mobil": ["exxonmobil", "exxon"],
    "conocophillips": ["conocophillips", "cop"],
    "marathon petroleum": ["marathonpetroleum", "mpc"],
    "nextera energy": ["nexteraenergy", "nextera", "fpl"],
    "american electric power": ["aep"],
    "consolidated edison": ["coned", "conedison"],
    "united parcel service": ["ups"],
    "charles schwab": ["schwab", "charlesschwab"],
    "fidelity investments": ["fidelity", "fmr"],
    "state street": ["statestreet"],
    "northern trust": ["northerntrust"],
    "capital one": ["capitalone"],
    "discover financial": ["discover"],
    "cvs health": ["cvshealth", "cvs"],
    "hca healthcare": ["hcahealthcare", "hca"],
    "kaiser permanente": ["kaiserpermanente", "kp"],
    "mass general brigham": ["massgeneralbrigham", "mgb", "partners"],
    "johns hopkins medicine": ["jhu", "johnshopkins"],
    "newyork-presbyterian": ["nyp", "newyorkpresbyterian"],
    "bristol myers squibb": ["bms", "bristolmyerssquibb"],
    "eli lilly": ["lilly", "elililly"],
    "becton dickinson": ["bd", "bectondickinson"],
    "boston scientific": ["bostonscientific", "bsc"],
    "texas instruments": ["ti", "texasinstruments"],
    "micron technology": ["micron"],
    "applied materials": ["appliedmaterials", "amat"],
    "western digital": ["westerndigital", "wdc"],
    "seagate technology": ["seagate"],
    "dell technologies": ["dell"],
    "cisco systems": ["cisco"],
    "dxc technology": ["dxc"],
    "ntt data": ["nttdata", "ntt"],
    "deere and company": ["johndeere", "deere"],
    "stanley black and decker": ["stanleyblackanddecker", "sbd"],
    "illinois tool works": ["itw"],
    "johnson controls": ["johnsoncontrols", "jci"],
    "trane technologies": ["trane"],
    "carrier global": ["carrier"],
    "coca-cola": ["cocacola", "coke"],
    "jm smucker": ["smucker", "jmsmucker"],
    "yum brands": ["yum"],
    "marriott international": ["marriott"],
    "mgm resorts": ["mgmresorts", "mgm"],
    "warner bros discovery": ["wbd", "warnerbros"],
    "charter communications": ["charter", "spectrum"],
    "t-mobile": ["tmobile"],
    "at&t": ["att"],
    "ch robinson": ["chrobinson", "chrw"],
    "jb hunt": ["jbhunt"],
    "old dominion freight": ["odfl", "olddominion"],
    "union pacific": ["unionpacific", "up"],
    "norfolk southern": ["norfolksouthern", "nscorp"],
    "delta air lines": ["delta"],
    "united airlines": ["united", "unitedairlines"],
    "american airlines": ["aa", "americanairlines"],
    "southwest airlines": ["southwest", "swa"],
    "alaska air group": ["alaskaair", "alaskaairlines"],
    "liberty mutual": ["libertymutual"],
    "state farm": ["statefarm"],
    "prudential financial": ["prudential"],
    "principal financial": ["principal"],
    "lincoln financial": ["lincolnfinancial", "lfg"],
    "voya financial": ["voya"],
    "guardian life": ["guardianlife", "guardian"],
    "erie insurance": ["erieinsurance", "erie"],
    "cincinnati financial": ["cinfin"],
    "regions bank": ["regions"],
    "fifth third bank": ["53", "fifththird"],
    "citizens bank": ["citizensbank", "citizens"],
    "huntington bank": ["huntington"],
    "m&t bank": ["mtb", "mtbank"],
    "ally financial": ["ally"],
    "pnc financial": ["pnc"],
    "us bancorp": ["usbank", "usbancorp"],
    "intercontinental exchange": ["ice"],
    "cme group": ["cmegroup", "cme"],
}
