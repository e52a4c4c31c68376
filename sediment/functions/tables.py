"""Rule tables and word lists of the posting domain. Every entry is a fixed value: results depend on these texts as they are.

Topics (themes, industries) change often: other ones can be read from JSON by topics().
"""

from __future__ import annotations

import json
from pathlib import Path

#: Markup to plain text, in order (Java patterns).
MARKUP = [
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</(p|div|li|h[0-9])>", "\n"),
    (r"<[^>]+>", " "),
    (r"(?i)&nbsp;", " "),
    (r"(?i)&amp;", "&"),
    (r"(?i)&lt;", "<"),
    (r"(?i)&gt;", ">"),
    (r"(?i)&#39;|&rsquo;|&lsquo;", "'"),
    (r"(?i)&quot;|&ldquo;|&rdquo;", '"'),
    (r"(?i)&[a-z#0-9]+;", " "),
]

#: Headings of sections.
HEADINGS = r"Overview|Responsibilities|(?:(?:Required(?:/Minimum)?|Minimum|Preferred|Additional(?: or Preferred)?) )?Qualifications|Benefits|Compensation|Other Requirements"

#: Where sections end, and how many years are asked for.
OVERVIEW_ENDS = r"Qualifications|Responsibilities|Required/Minimum|Additional or Preferred"
SHORT_OVERVIEW_ENDS = r"Qualifications|Responsibilities|Required/Minimum"
QUALIFICATIONS = "(?:Required/Minimum Qualifications|Qualifications)"
QUALIFICATIONS_ENDS = r"Responsibilities|Benefits|Microsoft is an equal"
YEARS = r"(?i)([0-9]{1,2})\+?\s*years?"

#: What a team says before or behind its own name.
OWN_BEFORE = r"(?:within|inside|part of|joining|join|welcome to|we are|we're|our|here at|in the|role in|role within|member of)\s+(?:the\s+)?(?:\w+(?:['’]s)?\s+)?(?:the\s+)?"
OWN_BEHIND = r"\s*(?:\([^)]{1,24}\)\s*)?(?:organi[sz]ation|team|group|division|business unit|is\s+(?:a|an|the)\s|is looking|is hiring|is seeking|are looking|are hiring|partners\b|builds\b|develops\b|delivers\b|operates\b|manages\b|owns\b|drives\b|runs\b)"

#: Legal and benefit passages that are removed before tagging, in order (Java patterns).
REMOVALS = [
    r"(?is)Microsoft is an equal opportunity employer.*\z",
    r"(?is)Microsoft(?:’|')s mission is to empower every person and every organization on the planet to achieve more.*?(?=\n\s*\n|\z)",
    r"(?i)In alignment with our Microsoft values[^\n]*",
    r"(?is)Ability to meet Microsoft, customer and\s*/?\s*or government security screening.*?(?=\n\s*\n|\z)",
    r"(?is)Microsoft Cloud Background Check.*?(?=\n\s*\n|\z)",
    r"(?i)(?:NV1|PV|NACI|Top Secret|TS/SCI)[^\n]*Clearance[^\n]*",
    r"(?i)This position may require an enhanced background check[^\n]*",
    r"(?is)[^\n]*typical base pay range for this role.*?(?=\n\s*\n|\z)",
    r"(?i)Certain roles may be eligible for benefits and other compensation[^\n]*",
    r"(?i)Benefits/perks listed below may vary[^\n]*",
    r"(?i)This position will be open for a minimum of[^\n]*",
    r"(?i)Microsoft will accept applications[^\n]*",
    r"(?i)Starting\s+\w+\s+\d{1,2},\s*\d{4},\s*Microsoft[^\n]*",
    r"(?i)online (?:services|businesses)[^.\n]{0,240}\.",
    r"https?://\S+",
]

#: Clauses that list choices; what they name isn't demanded.
OPEN_LISTS = [
    r"\blanguages?,?\s+includ(?:ing|e)\b[^.]*\.?",
    r"\bexperience\s+(?:in|with)\b[^;\n]{0,240}?\bor\s+(?:related|similar)\s+(?:roles?|fields?|areas?|disciplines?|experience|domains?)\b",
    r"\bdegree\s+in\s+[^.;\n]{0,120}?(?=\s+(?:AND|OR)\b|[.;\n]|$)",
]

#: Degrees, the highest first.
DEGREES = [("PhD", r"\b(ph\.?d|doctorate)\b"), ("Master's", r"\bmaster'?s?\b|\bm\.?s\.?\b|\bmba\b"), ("Bachelor's", r"\bbachelor'?s?\b|\bb\.?s\.?\b|\bundergraduate degree\b")]

#: Short names of countries.
COUNTRIES = {"USA": "United States", "UK": "United Kingdom"}

#: Functions of professions, in order.
FUNCTIONS = [
    ("build", r"software engineering|hardware engineering|research, applied|security engineering|quantum|design & creative|product management|program management|technical program"),
    ("capacity", r"data center|real estate|supply chain|manufacturing|construction"),
    ("gtm", r"sales|customer success|consulting|technical support|marketing|business development|partner|evangelism"),
    ("run", r"finance|human resources|legal|business operations|administration|governance, risk|communications|security & safety"),
]

#: Bands of seniority.
BANDS = [
    ("entry", ("Intern / University", "Associate / Entry")),
    ("mid", ("Mid / Unspecified",)),
    ("senior", ("Senior", "Lead / Staff")),
    ("principal", ("Principal", "Partner (Distinguished)")),
    ("manager", ("Manager", "Director", "General Manager", "Vice President+")),
]

#: Orders of lists that aren't ranked.
SENIORITY_ORDER = ("Intern / University", "Associate / Entry", "Mid / Unspecified", "Senior", "Lead / Staff", "Principal", "Manager", "Director", "Partner (Distinguished)", "General Manager", "Vice President+")
DEGREE_ORDER = ("Bachelor's", "Master's", "PhD", "Not stated")

#: Groups of archetypes and seniorities.
DELIVERY = ("architect", "consultant", "delivery_lead", "program", "data_ai", "engineer", "support", "security")
DEMAND = ("sales", "csam")
CONSULTING = ("architect", "consultant", "delivery_lead")
SENIOR_PLUS = ("Senior", "Lead / Staff", "Principal", "Partner (Distinguished)")
LEADERSHIP = ("Manager", "Director", "General Manager", "Vice President+")
AI_STACK = ("llm", "agents", "rag", "aifoundry", "copilot_dev", "mlops")
OPEN_LIST_SKILLS = ("any_lang", "any_background")

#: Fields whose changes are reported.
TRACKED = ("title", "department", "profession", "discipline", "roleType", "employmentType", "workSite", "travel", "seniority", "locations", "org", "descriptionHash")

#: Units by department and by profession.
DEPARTMENTS = {
    "cloud solution architecture": "csu",
    "customer success account mgmt": "csu",
    "solution engineering": "stu",
    "solution area specialists": "stu",
    "account technology": "atu",
    "strategic account technology": "atu",
    "account management": "atu",
    "strategic account management": "atu",
    "services account management": "atu",
    "partner development management": "gps",
    "partner solution sales": "gps",
    "partner enablement program mgmt": "gps",
    "technology consulting": "isd",
    "solution architecture": "isd",
    "consulting project management": "isd",
}
PROFESSIONS = {"digital sales and solutions": "digitalsales"}

#: A topic, an action, and what denies both.
SIGNALS = [
    ("production-ai", r"\b(?:AI|artificial intelligence|agentic|copilot|machine learning)\b", r"\b(?:deploy\w*|production|implement\w*|build\w*|operationali[sz]\w*)\b"),
    ("business-outcomes", r"\b(?:business outcomes?|customer outcomes?|business value|return on investment|ROI|industry-specific)\b", r"\b(?:deliver(?:s|ed|ing)?|driv\w*|reali[sz]\w*|measur\w*|achiev\w*|transform\w*)\b"),
    ("reusable-delivery", r"\b(?:reusab\w*|repeatab\w*|accelerators?|intellectual property|delivery assets?)\b", r"\b(?:build\w*|develop\w*|creat\w*|scal\w*|engineer\w*|standard\w*|leverag\w*)\b"),
    ("adoption", r"\b(?:adoption|consumption|productive use|time.to.value)\b", r"\b(?:accelerat\w*|driv\w*|enabl\w*|deliver(?:s|ed|ing)?|increas\w*|improv\w*)\b"),
    ("trusted-delivery", r"\b(?:governance|compliance|security|regulated|responsible AI)\b", r"\b(?:design(?:s|ed|ing)?|implement(?:s|ed|ing)?|integrat(?:e|es|ed|ing)|architecting|deliver(?:s|ed|ing)?|embed(?:s|ded|ding)?|solv(?:e|es|ed|ing))\b"),
]
NEGATION = r"\b(?:not|never|no longer|will not|won't)\b"

#: Words of titles that are no keywords.
TITLE_WORDS = tuple(
    """senior principal manager director lead staff intern internship and or the of for a in to ii iii iv i sr jr
    new grad level associate partner group general vice president""".split()
)

#: Seniority by title, in order.
SENIORITY = [
    ("Intern / University", r"\b(intern|internship|university|new grad|graduate program|apprentice|aspire)\b"),
    ("Vice President+", r"\b(corporate vice president|vice president|cvp|evp)\b"),
    ("General Manager", r"\b(general manager)\b"),
    ("Partner (Distinguished)", r"\bpartner\s+(director|group|software|hardware|architect|solution|research|program|product|data|applied|design|marketing|technical|engineering|manager|scientist)"),
    ("Partner (Distinguished)", r"\b(distinguished|technical fellow|fellow)\b"),
    ("Director", r"\bdirector\b"),
    ("Principal", r"\bprincipal\b"),
    ("Senior", r"\b(senior|sr\.?)\b"),
    ("Lead / Staff", r"\b(lead|staff)\b"),
    ("Manager", r"\bmanager\b"),
    ("Associate / Entry", r"\b(associate|junior|jr\.?|entry)\b"),
]

#: Archetypes by title, in order.
ARCHETYPES = [
    ("business_support", r"\bexecutive (?:assistant|business administrator)\b|\badministrative assistant\b|\bbusiness administrator\b|\b\(EA\)"),
    ("leadership", r"\b(director|general manager|vice president|\bcvp\b|\bcto\b|chief technology officer|chief of staff|head of)\b"),
    ("architect", r"\barchitect(?:ure)?\b"),
    ("consultant", r"\bconsultant\b|\bconsulting\b|\badvisor\b|\badvisory\b"),
    ("delivery_lead", r"\b(delivery|engagement|practice|portfolio|service)\s+(lead|leader|manager|management|director|executive|partner)\b|\bdelivery (?:excellence|management)\b|\bengagement manager\b"),
    ("program", r"\b(program|programme|project|technical program)\s+manager\b|\bTPM\b|\bproject management\b|\bscrum master\b"),
    ("csam", r"\bcustomer success account manager\b|\bCSAM\b|\bcustomer success manager\b"),
    ("sales", r"\b(account executive|account manager|account technology|sales|seller|specialist|business development|solution area)\b"),
    ("data_ai", r"\b(data scientist|data engineer|machine learning|applied scientist|\bAI\b engineer|ai engineer|research scientist)\b"),
    ("engineer", r"\b(software engineer|forward deployed|developer|full[- ]stack|platform engineer|devops engineer|site reliability)\b"),
    ("support", r"\b(support engineer|escalation engineer|technical support|customer engineer|technical account manager)\b"),
    ("security", r"\b(security|cybersecurity|incident response|compliance)\b"),
    ("manager", r"\bmanager\b|\bmanagement\b|\blead\b"),
]

#: Products.
PRODUCTS = [
    ("Azure", r"\bazure\b"),
    ("Copilot", r"\bcopilot\b"),
    ("Microsoft 365", r"\b(microsoft 365|m365|office 365|o365)\b"),
    ("Dynamics 365", r"\bdynamics(\s?365)?\b"),
    ("Power BI", r"\bpower ?bi\b"),
    ("Power Platform", r"\bpower (platform|apps|automate|pages)\b"),
    ("Microsoft Fabric", r"\b(microsoft|ms) fabric\b|\bfabric (workspace|capacity|lakehouse|platform)\b"),
    ("Microsoft Teams", r"\b(microsoft|ms) teams\b|\bteams (client|meetings|rooms|platform|calling)\b"),
    ("GitHub", r"\bgithub\b"),
    ("Xbox", r"\bxbox\b"),
    ("LinkedIn", r"\blinkedin\b"),
    ("Windows", r"\bwindows (server|client|os|11|10|365)\b|\bwindows\b(?! of )"),
    ("Surface", r"\bmicrosoft surface\b|\bsurface (device|pro|laptop|hub|duo|studio)\b"),
    ("SharePoint", r"\bsharepoint\b"),
    ("Visual Studio", r"\bvisual studio\b|\bvs code\b"),
    ("Microsoft Defender", r"\bdefender\b"),
    ("Microsoft Sentinel", r"\bsentinel\b"),
    ("Entra ID", r"\bentra\b"),
    ("Purview", r"\bpurview\b"),
    ("OpenAI", r"\bopen ?ai\b"),
    ("Kubernetes", r"\b(kubernetes|\baks\b)"),
    ("SQL Server", r"\bsql server\b"),
    ("Cosmos DB", r"\bcosmos ?db\b"),
    ("Synapse", r"\bsynapse\b"),
    ("HoloLens", r"\bhololens\b"),
    ("Minecraft", r"\bminecraft\b"),
    ("Bing", r"\bbing\b"),
    ("Viva", r"\bviva\b"),
    ("Azure AI Foundry", r"\bai foundry\b"),
    (".NET", r"(^|[^a-z0-9])\.net\b"),
]

#: Fixed values.
SOLUTION_AREAS = [
    ("data_ai", r"\bData\s*(?:&|and)\s*AI\b|\bAzure Data\b"),
    ("infra", r"\bAzure Infrastructure\b|\bCloud\s*(?:&|and)\s*AI Infrastructure\b|\bInfrastructure Solution Area\b"),
    ("apps", r"\bDigital\s*(?:&|and)\s*App(?:lication)? Innovation\b|\bApp Innovation\b"),
    ("bizapps", r"\bBusiness Applications\b|\bDynamics 365\b"),
    ("modernwork", r"\bModern Work\b"),
    ("securitysa", r"\bSecurity Solution Area\b|\bcybersecurity solutions?\b|\bMicrosoft Security\b"),
]

#: Fixed values.
INITIATIVES = [
    ("frontier_firm", r"\bFrontier Firm\b|\bfrontier transformation\b|\bFrontier Industry\b"),
    ("frontier_models", r"\bfrontier (?:AI|model|models|scale|training)\b|\bfrontier[- ]class\b"),
    ("agentic", r"\bagentic\b|\bAI agents?\b|\bagent framework\b"),
    ("sovereign", r"\bsovereign(?: cloud| ai)?\b|\bair[- ]gapped\b|\bgovernment cloud\b|\bFedRAMP\b|\bIL[45]\b"),
    ("security_future", r"(?-i:\bSecure Future Initiative\b|\bSFI\b)"),
]

#: Units, their parent, how they are named, and whether their own word goes before their department's.
UNITS = [
    ("atu", "mcaps", r"\bATU\b|Account Team Unit", False),
    ("csu", "mcaps", r"\bCSU\b|Customer Success Unit", False),
    ("gps", "mcaps", r"\bGPS\b|Global Partner Solutions", False),
    ("css", "mcaps", r"Customer Service\s*(?:&|and)\s*Support", False),
    ("ces", "mcaps", r"\bCE&S\b|Customer Experience\s*(?:&|and)\s*Success", False),
    ("smec", "mcaps", r"\bSME&C\b|Small,?\s*Medium Enterprises?\s*(?:&|and)\s*Channel", False),
    ("stu", "mcaps", r"\bSTU\b|Solution Team Unit", False),
    ("mcaps", "mcaps", r"\bMCAPS\b|Microsoft Customer and Partner Solutions", False),
    ("gbb", "mcaps", r"Global Black Belt|\bGBB\b", True),
    ("ceai", "mcaps", r"\bCEAI\b|Commercial Engineering\s*(?:&|and)\s*AI", True),
    ("digitalsales", "mcaps", r"\bDigital Natives?\b|\bDigital Sales\b", True),
    ("msdigital", "mcaps", r"\bMicrosoft Digital\b", True),
    ("isd", "frontier", r"\bISD\b|Industry Solutions Delivery|Microsoft Industry Solutions|\bGCID\b|Global Cent(?:er|re) (?:for )?Innovation and Delivery", False),
    ("fde", "frontier", r"\bFDE\b|Forward Deployed Engineer", False),
    ("frontier", "frontier", r"Microsoft Frontier Company|Frontier Company|frontier organization", False),
    ("coi", "engineering", r"\bCO\s?[+&]\s?I\b|Cloud Operations\s*(?:\+|&|and)\s*Innovation", False),
    ("schie", "engineering", r"\bSCHIE\b|Silicon,?\s*Cloud Hardware", False),
    ("mai", "engineering", r"\bMicrosoft AI\b|\bMAI\b", False),
    ("coreai", "engineering", r"\bCoreAI\b|\bCore AI\b", False),
    ("security", "engineering", r"\bMicrosoft Security\b|\bSecurity Division\b", False),
    ("cloudai", "engineering", r"\bCloud\s*\+\s*AI\b", False),
    ("ed", "engineering", r"\bE\+D\b|Experiences\s*\+\s*Devices", False),
    ("msr", "engineering", r"\bMicrosoft Research\b|\bMSR\b", False),
    ("gaming", "engineering", r"\bXbox\b|Game Studios|\bMicrosoft Gaming\b|\bGaming (?:organization|division|team)\b", False),
    ("linkedin", "engineering", r"\bLinkedIn\b", False),
]

#: Skills, their category, and how they are named.
SKILLS = [
    ("python", "lang", r"\bpython\b"),
    ("csharp", "lang", r"\bc#|\bc\s?sharp\b|\.net\b"),
    ("java", "lang", r"\bjava\b(?!script)"),
    ("js", "lang", r"\bjavascript\b|\btypescript\b|\breact\b|\bnode\.?js\b"),
    ("cpp", "lang", r"\bc\+\+|\bc/c\+\+"),
    ("go", "lang", r"\bgolang\b|\bgo\s+(?:programming|language)\b"),
    ("rust", "lang", r"\brust\b"),
    ("sql", "lang", r"\bsql\b|\bt-sql\b|\bkql\b"),
    ("shell", "lang", r"\bpowershell\b|\bbash\b|\bshell scripting\b"),
    ("any_lang", "openlist", r"\blanguages?,?\s+includ(?:ing|e)\b"),
    ("any_background", "openlist", r"\bor\s+(?:related|similar)\s+(?:roles?|fields?|areas?|disciplines?|experience|domains?)\b"),
    ("azure", "cloud", r"\bazure\b"),
    ("aws_gcp", "cloud", r"\baws\b|\bamazon web services\b|\bgoogle cloud\b|\bgcp\b"),
    ("k8s", "cloud", r"\bkubernetes\b|\bk8s\b|\bdocker\b|\bcontaineri[sz]ation\b"),
    ("iac", "cloud", r"\bterraform\b|\bbicep\b|\barm templates?\b|\binfrastructure as code\b|\bansible\b|\bpulumi\b"),
    ("linux", "cloud", r"\blinux\b|\bunix\b"),
    ("networking", "cloud", r"\bnetworking\b|\btcp/ip\b|\bbgp\b|\bdns\b|\bload balanc"),
    ("distributed", "cloud", r"\bdistributed systems?\b|\bmicroservices?\b|\bhigh availability\b|\bscalab(?:le|ility) (?:systems?|architecture)\b"),
    ("ml", "data_ai", r"\bmachine learning\b|\bdeep learning\b|\bneural network"),
    ("llm", "data_ai", r"\blarge language model|\bllms?\b|\bgenerative ai\b|\bgenai\b|\bfoundation models?\b|\bfine[- ]tuning\b"),
    ("mlframe", "data_ai", r"\bpytorch\b|\btensorflow\b|\bonnx\b|\bhugging ?face\b|\bcuda\b"),
    ("dataeng", "data_ai", r"\bdata engineering\b|\betl\b|\bdata pipelines?\b|\bdata warehous|\bspark\b|\bdatabricks\b|\bsynapse\b"),
    ("analytics", "data_ai", r"\bpower ?bi\b|\bdata analysis\b|\bdata visuali[sz]ation\b|\bbusiness intelligence\b|\bdashboards?\b"),
    ("mlops", "data_ai", r"\bmlops\b|\bmodel deployment\b|\bmodel monitoring\b|\bmodel serving\b|\binference optimi[sz]ation\b"),
    ("stats", "data_ai", r"\bstatistics\b|\bstatistical\b|\ba/b test|\bexperimentation\b|\bcausal inference\b"),
    ("agents", "agentic", r"\bagentic\b|\bai agents?\b|\bagent frameworks?\b|\bmulti[- ]agent\b|\bautogen\b|\bsemantic kernel\b|\blangchain\b|\bmodel context protocol\b|\bmcp\b"),
    ("copilot_dev", "agentic", r"\bcopilot studio\b|\bmicrosoft copilot\b|\bcopilot extensib"),
    ("rag", "agentic", r"\bretrieval[- ]augmented\b|\brag\b|\bprompt engineering\b|\bvector (?:search|database|store)\b|\bembeddings?\b"),
    ("aifoundry", "agentic", r"\bai foundry\b|\bazure openai\b|\bopenai\b"),
    ("secops", "security", r"\bsecurity operations\b|\bsiem\b|\bincident response\b|\bthreat (?:detection|hunting|intelligence)\b|\bsentinel\b|\bsoc analyst\b"),
    ("appsec", "security", r"\bapplication security\b|\bcloud security\b|\bsecure coding\b|\bthreat model|\bpenetration test|\bvulnerability (?:management|assessment)\b"),
    ("iam", "security", r"\bidentity and access\b|\biam\b|\bentra\b|\bactive directory\b|\bzero trust\b|\boauth\b|\bsso\b"),
    ("crypto", "security", r"\bcryptograph|\bencryption\b|\bpki\b|\bkey management\b"),
    ("compliance", "security", r"\bsoc ?2\b|\biso ?27001\b|\bnist\b|\bfedramp\b|\bgdpr\b|\bhipaa\b|\bpci[- ]dss\b|\bregulatory compliance\b"),
    ("critenv", "infra", r"\bcritical environment\b|\bdata ?cent(?:er|re) operations\b|\bups\b|\bgenerators?\b|\bswitchgear\b|\bcooling systems?\b"),
    ("electrical", "infra", r"\belectrical engineering\b|\bmechanical engineering\b|\bhvac\b|\bmedium voltage\b|\bpower distribution\b"),
    ("construction", "infra", r"\bconstruction management\b|\bcommissioning\b|\bgeneral contractor|\bsite selection\b|\bpermitting\b"),
    ("supplychain", "infra", r"\bsupply chain\b|\bsourcing\b|\bprocurement\b|\blogistics\b|\bdemand planning\b|\binventory management\b"),
    ("rtl", "silicon", r"\brtl\b|\bverilog\b|\bsystemverilog\b|\bvhdl\b|\buvm\b|\bdesign verification\b"),
    ("chip", "silicon", r"\basic\b|\bfpga\b|\bsystem[- ]on[- ]chip\b|\bsoc design\b|\bphysical design\b|\btiming closure\b|\bsynthesis\b"),
    ("board", "silicon", r"\bpcb\b|\bsignal integrity\b|\bpower integrity\b|\bschematic\b|\bthermal (?:design|analysis)\b"),
    ("firmware", "silicon", r"\bfirmware\b|\bembedded systems?\b|\bdevice drivers?\b|\bbios\b|\buefi\b"),
    ("cicd", "practice", r"\bci/cd\b|\bcontinuous (?:integration|delivery|deployment)\b|\bdevops\b|\bgithub actions\b|\bazure devops\b"),
    ("sre", "practice", r"\bsite reliability\b|\bsre\b|\bobservability\b|\bmonitoring and alerting\b|\bslo\b|\bon[- ]call\b"),
    ("agile", "practice", r"\bagile\b|\bscrum\b|\bkanban\b|\bsprint\b"),
    ("testing", "practice", r"\bunit test|\btest automation\b|\bquality assurance\b|\btest[- ]driven\b"),
    ("architecture", "practice", r"\bsystem design\b|\bsolution architecture\b|\barchitectural (?:design|patterns?)\b|\bdesign patterns?\b|\bapi design\b"),
    ("stakeholder", "delivery", r"\bstakeholder (?:management|engagement)\b|\bexecutive (?:presence|communication|engagement)\b|\bc[- ]level\b|\binfluenc(?:e|ing) without authority\b"),
    ("delivery_mgmt", "delivery", r"\bproject management\b|\bprogram(?:me)? management\b|\bdelivery management\b|\bportfolio management\b"),
    ("consulting", "delivery", r"\bconsult(?:ing|ant|ancy)\b|\badvisory\b|\bclient engagements?\b|\bworkshops?\b"),
    ("presales", "commercial", r"\bpre[- ]?sales\b|\bsolution selling\b|\btechnical sales\b|\bproof of concept\b"),
    ("customer_facing", "commercial", r"\bcustomer[- ]facing\b|\bclient[- ]facing\b"),
    ("quota", "commercial", r"\bquota\b|\bpipeline management\b|\brevenue targets?\b|\bsales forecast|\bclosing deals\b|\bdeal (?:cycle|structuring|closure)\b"),
    ("industry_know", "commercial", r"\bindustry (?:knowledge|expertise)\b|\bdomain (?:knowledge|expertise)\b|\bvertical expertise\b"),
    ("clearance", "credential", r"\bsecurity clearance\b|\btop secret\b|\bts/sci\b|\bpolygraph\b|\bnv1\b|\bbaseline clearance\b"),
    ("azure_cert", "credential", r"\baz-\d{3}\b|\bazure certif|\bmicrosoft certified\b"),
    ("pm_cert", "credential", r"\bpmp\b|\bprince2\b|\bitil\b|\bcsm\b|\bscrum master certif"),
    ("sec_cert", "credential", r"\bcissp\b|\bcism\b|\bceh\b|\bcomptia\b|\bsecurity\+\b"),
]

#: Words that carry no content.
COMMON_WORDS = tuple(
    """the and for with you our your this that are will have has from their they them not
    but all can may who how what when more other than into across within work working role roles
    team teams years year experience required preferred qualifications minimum additional responsibilities overview ability including such also well new
    one two both must should would could been being was were his her its about over under while
    each any per via use used using make made help helps need needs these those there here then
    them through between because microsoft company employees equivalent degree bachelor master field related demonstrated strong excellent proven skills
    knowledge understanding apply applicants job position positions candidate candidates opportunity opportunities day days most many ensure ensuring provide
    providing various multiple key high level best same own out off end part set directly like want able
    you’ll we’ll join looking ways time right first""".split()
)

#: Themes of postings and their keywords.
THEMES = {
    "ai_copilot": ["copilot", "openai", "ai foundry", "azure ai", "generative ai", "genai", "llm", "large language model", "agentic", "ai agent", "semantic kernel", "prompt engineering", "foundation model", "inference"],
    "ml_research": ["machine learning", "deep learning", "applied scientist", "research scientist", "reinforcement learning", "computer vision", "natural language processing", "speech recognition", "model training", "pytorch", "recommendation system"],
    "cloud_azure": ["azure", "kubernetes", "virtual machine", "iaas", "paas", "cloud native", "serverless", "container", "distributed systems", "hypervisor", "networking stack"],
    "datacenter": ["datacenter", "data center", "critical environment", "colocation", "commissioning", "capacity planning", "power and cooling", "site selection", "construction management", "mechanical electrical", "facilities engineering"],
    "silicon": ["silicon", "asic", "soc", "rtl", "verilog", "fpga", "pcb", "signal integrity", "thermal", "firmware", "semiconductor", "chip design", "hardware validation"],
    "security": ["cybersecurity", "security engineering", "security engineer", "security operations", "information security", "application security", "cloud security", "security architect", "security research", "defender for endpoint", "microsoft defender", "microsoft sentinel", "entra", "zero trust", "threat detection", "threat intelligence", "threat modeling", "vulnerability management", "penetration test", "cryptograph", "identity and access", "purview", "malware", "red team"],
    "data_analytics": ["fabric", "power bi", "data engineer", "data platform", "synapse", "data warehouse", "etl", "analytics", "databricks", "cosmos db", "sql server"],
    "m365": ["microsoft 365", "m365", "sharepoint", "outlook", "onedrive", "viva", "microsoft teams", "productivity suite", "office 365"],
    "biz_apps": ["dynamics 365", "business applications", "power platform", "power apps", "power automate", "erp", "crm", "supply chain management", "finance and operations"],
    "gaming": ["xbox", "gaming", "game studio", "activision", "blizzard", "game development", "console", "game pass", "minecraft"],
    "devices": ["surface", "hololens", "mixed reality", "industrial design", "device manufacturing", "accessories", "wearable"],
    "linkedin": ["linkedin"],
    "windows": ["windows", "client os", "kernel", "device driver", "operating system"],
    "devtools": ["github", "visual studio", "vs code", "developer tools", "devops", "ci/cd", "sdk", ".net", "typescript", "open source"],
    "gtm": ["quota", "pipeline", "account executive", "customer success", "solution sales", "partner ecosystem", "go-to-market", "territory", "revenue growth", "consumption growth", "renewal", "deal"],
    "industry": ["healthcare", "financial services", "public sector", "government", "federal", "defense", "sovereign cloud", "retail industry", "manufacturing industry", "education sector", "automotive"],
    "quantum": ["quantum", "majorana", "topological qubit", "qubit"],
    "sustainability": ["sustainability", "carbon", "renewable energy", "energy strategy", "water stewardship", "net zero"],
    "trust": ["responsible ai", "trust and safety", "privacy", "regulatory", "public policy", "accessibility", "ethics", "content moderation"],
    "corporate": ["financial planning", "human resources", "talent acquisition", "legal counsel", "procurement", "accounting", "internal audit", "corporate strategy", "payroll", "benefits"],
}

#: Industries of customers and their keywords.
INDUSTRIES = {
    "public": ["public sector", "government", "federal agencies", "state and local", "citizen services", "fedramp", "government agencies", "public administration", "civilian agencies"],
    "defense": ["department of defense", "national security", "defense", "defence", "warfighter", "intelligence community", "classified environments", "air gapped", "gcc high", "nato", "military", "security clearance"],
    "finserv": ["financial services", "banking", "capital markets", "insurance", "fintech", "payments", "wealth management", "financial institutions", "basel", "trading platform"],
    "health": ["healthcare", "health care", "life sciences", "clinical", "patient", "electronic health record", "fhir", "hipaa", "payers and providers", "pharmaceutical", "medical imaging", "health systems"],
    "manufacturing": ["manufacturing industry", "manufacturing customers", "discrete manufacturing", "process manufacturing", "automotive", "industrial equipment", "shop floor", "factory operations", "digital twin", "product lifecycle management", "industrial iot", "mobility industry"],
    "energy": ["oil and gas", "energy industry", "energy sector", "energy customers", "energy and resources", "utilities", "grid operator", "upstream operations", "mining industry", "natural resources"],
    "retail": ["retail industry", "retail customers", "retailers", "consumer goods", "merchandising", "point of sale", "omnichannel", "e-commerce", "store operations", "consumer packaged goods"],
    "telco": ["telecommunications", "telco", "network operator", "media and entertainment", "broadcast", "content delivery", "operator network", "communications industry"],
    "education": ["higher education", "k-12", "edtech", "academic institutions", "student success", "education sector", "education industry", "education customers"],
    "sovereign_ind": ["sovereign cloud", "data residency", "data sovereignty", "regulated industries", "regulated customers", "national cloud", "regulatory compliance requirements"],
}


def topics(path: str) -> dict[str, list[str]]:
    """Keywords of topics from a JSON object, in its order."""
    found = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict) or not all(isinstance(w, list) and w and all(isinstance(k, str) and k.strip() for k in w) for w in found.values()):
        raise ValueError(f"{path}: an object of topics, each with a list of keywords, is asked for")
    return found
