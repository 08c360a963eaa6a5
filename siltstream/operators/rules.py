"""Detection rules: our starter set, the technique catalog, and validation."""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, techniques, confidences and scopes. The patterns are ours, written for the technique.
#: (rule, technique, confidence, scope, pattern). Segment rules see one simple command, command rules the whole line.
RULES: list[tuple[str, str, str, str, str]] = [
    ("discovery-system-info", "T1082", "high", "segment", r"^(uname|lscpu|nproc|hostnamectl|free|uptime|arch|lsb_release)\b|^df\b"),
    ("discovery-system-files", "T1082", "high", "segment", r"^(cat|head|grep|more|less)\b.*(/proc/(cpuinfo|meminfo|version|uptime|mounts|partitions)|/etc/(os-release|issue|\S*-release))"),
    ("discovery-current-user", "T1033", "high", "segment", r"^(whoami|id|w|who|last|logname)(\s|$)"),
    ("discovery-network-config", "T1016", "high", "segment", r"^(ifconfig|route)\b|^ip\s+(-\S+\s+)*(a|addr|address|r|route|link|n|neigh)\b|^cat\s+/etc/resolv\.conf"),
    ("discovery-external-ip", "T1016.001", "high", "segment", r"(ifconfig\.(me|co)|ipinfo\.io|icanhazip\.com|api\.ipify\.org|checkip\.|ident\.me)"),
    ("discovery-network-connections", "T1049", "high", "segment", r"^(netstat|ss)\b|^lsof\s+.*-i|^cat\s+/proc/net/(tcp|udp)"),
    ("discovery-processes", "T1057", "high", "segment", r"^(ps|top|htop|pgrep|pidof|pstree)(\s|$)"),
    ("discovery-files", "T1083", "low", "segment", r"^(ls|find|dir|tree|locate)(\s|$)"),
    ("discovery-local-accounts", "T1087.001", "high", "segment", r"^(cat|grep|cut|awk|head|less|more)\b.*/etc/passwd|^getent\s+passwd"),
    ("discovery-local-groups", "T1069.001", "medium", "segment", r"^groups(\s|$)|/etc/group\b|^getent\s+group"),
    ("discovery-software", "T1518", "low", "segment", r"^(which|whereis|dpkg\s+-l|rpm\s+-qa|apt\s+list)\b|^command\s+-v\b"),
    ("discovery-busybox-probe", "T1518", "low", "segment", r"^busybox\s+[A-Z]{3,}"),
    ("discovery-services", "T1007", "medium", "segment", r"^(systemctl\s+(status|list-\S+)|service\s+(--status-all|\S+\s+status)|rc-status|chkconfig\s+--list)"),
    ("discovery-system-time", "T1124", "low", "segment", r"^(date|timedatectl|hwclock)(\s|$)"),
    ("discovery-log-enumeration", "T1654", "medium", "segment", r"^(cat|tail|head|grep|less|more|ls|find)\b.*/var/log\b|^journalctl\b|^lastlog\b"),
    ("discovery-remote-systems", "T1018", "medium", "segment", r"^(ping|traceroute|tracepath|nslookup|dig|host)\s|^arp\b|^(cat|grep|less|more)\s.*/etc/hosts(\s|$)"),
    ("discovery-network-scan", "T1046", "high", "segment", r"^(nmap|masscan|zmap|zgrab|pnscan)\b|^nc\s+(-\S+\s+)*-\w*z"),
    ("discovery-password-policy", "T1201", "medium", "segment", r"(/etc/login\.defs|/etc/pam\.d/common-password|^chage\s+-l|pwquality\.conf)"),
    ("discovery-virtualization", "T1497", "high", "segment", r"systemd-detect-virt|virt-what|/\.dockerenv|/proc/(1|self)/cgroup|grep\s+.*(virtual|hypervisor|vmware|qemu|kvm)|/sys/(class/dmi|hypervisor)|^(dmesg|lspci|dmidecode)\b"),
    ("discovery-ssh-version", "T1518", "low", "segment", r"^sshd?\s+(-\S+\s+)*-\w*V\b"),
    ("credential-shadow", "T1003.008", "high", "segment", r"/etc/(shadow|gshadow|master\.passwd)\b"),
    ("credential-shell-history", "T1552.003", "high", "segment", r"^(cat|grep|head|tail|less|more|strings)\b.*\.(bash|zsh|ash|sh)_history|^history(\s+\d+)?$"),
    ("credential-private-keys", "T1552.004", "medium", "segment", r"\bid_(rsa|dsa|ecdsa|ed25519)\b|\.pem\b|find\b.*\.key\b|^ls\b.*/\.ssh/?(\s|$)"),
    ("credential-files", "T1552.001", "high", "segment", r"\.(aws/credentials|kube/config|netrc|npmrc|pypirc|git-credentials|pgpass|my\.cnf|docker/config\.json)\b|wp-config\.php|/\.env\b"),
    ("wallet-files", "T1005", "medium", "segment", r"wallet\.dat|\.electrum|\.bitcoin|\.ethereum|/keystore\b|\bseed\.txt|\bD877F783D5D3EF8C"),
    ("credential-brute-force-tool", "T1110", "high", "segment", r"^(hydra|medusa|ncrack|patator|crowbar|john|hashcat|sshpass\s+-f)(\s|$)"),
    ("persistence-ssh-keys", "T1098.004", "high", "command", r"(>>?|tee|cp|mv|echo|chmod|chown).*authorized_keys|ssh-rsa\s+AAAA.*authorized_keys|\bssh-copy-id\s"),
    ("persistence-cron-write", "T1053.003", "high", "command", r"(^|[;&|(]\s*|sudo\s+)crontab\s+([^-\s|;&)]|-\s*$|-r\b)|\|\s*crontab|(>>?|\b(cp|mv|tee)\s.*)\s*/(etc/cron|var/spool/cron)"),
    ("persistence-cron-list", "T1053.003", "low", "segment", r"^crontab\s+-l|^(cat|ls)\b.*/etc/cron"),
    ("persistence-systemd-enable", "T1543.002", "high", "segment", r"^systemctl\s+(--\S+\s+)*(enable|daemon-reload)\b|^chkconfig\s+\S+\s+on"),
    ("persistence-systemd-unit", "T1543.002", "high", "command", r"(>>?|tee|cp|mv)\s*.*/(etc|lib|usr/lib)/systemd/system/\S+\.service"),
    ("persistence-rc-scripts", "T1037.004", "high", "command", r"(>>?|tee|cp|mv|sed\s+-i)\s*.*/etc/(rc\.local|rc\.d|init\.d)|\bupdate-rc\.d\s+\S+\s+(defaults|enable)"),
    ("persistence-shell-profile", "T1546.004", "high", "command", r"(>>?|tee)\s*\S*(\.bashrc|\.profile|\.bash_profile|/etc/profile|\.zshrc)|\b(cp|mv)\s.*(/etc/profile\.d/|\.bashrc|\.bash_profile)"),
    ("persistence-create-account", "T1136.001", "high", "segment", r"^(useradd|adduser)\b"),
    ("persistence-passwd-write", "T1136.001", "high", "command", r">>?\s*/etc/passwd"),
    ("persistence-account-manipulation", "T1098", "high", "segment", r"^(passwd|chpasswd|usermod)\b|^echo\b.*\|\s*(passwd|chpasswd)"),
    ("persistence-ld-preload", "T1574.006", "high", "command", r"/etc/ld\.so\.preload|LD_PRELOAD="),
    ("privesc-sudo-use", "T1548.003", "low", "command", r"(^|[;&|(]\s*)sudo\s"),
    ("privesc-sudoers", "T1548.003", "high", "command", r"/etc/sudoers|\bvisudo\b"),
    ("evasion-chattr", "T1222.002", "medium", "segment", r"^chattr\b"),
    ("privesc-setuid", "T1548.001", "medium", "segment", r"^chmod\s+(-\S+\s+)*([ugoa]*\+\w*s|[24567]\d{3}\b)"),
    ("c2-download", "T1105", "high", "segment", r"^(wget|curl)(?=\s)(?!.*(ifconfig\.(me|co)|ipinfo\.io|icanhazip|ipify|checkip|ident\.me))(?!.*\s(-T|-F|--upload-file|--data-binary)\b)|^(tftp|ftpget|fetch|lwp-download|aria2c|axel)\s|^git\s+clone\b|^(scp|rsync)\s+(-\S+\s+)*\S+:\S+\s+[^\s:]+$|^echo\s.*\b(wget|curl)\s.*://.*>\s*\S*cron"),
    ("exec-permission-change", "T1222.002", "medium", "segment", r"^chmod\s+(-\S+\s+)*([ugoa]*\+[rwX]*x|[ugoa]+=[rwxX]*|[0-7]*7[0-7]*)(\s|$)"),
    ("exec-shell", "T1059.004", "medium", "segment", r"^(ba|da|a|z|k)?sh(\s+\S+|\s*$)|^(\.|source)\s+\S"),
    ("exec-pipe-to-shell", "T1059.004", "high", "command", r"^(?!\s*echo\s.*>\s*\S*cron).*\|\s*(sudo\s+)?(/\S*/)?(ba|da|a|z|k)?sh\b"),
    ("exec-dropped-file", "T1059.004", "low", "segment", r"^(\./|/tmp/|/var/tmp/|/dev/shm/)\S+"),
    ("exec-python", "T1059.006", "high", "segment", r"^python[0-9.]*\s"),
    ("exec-python-pipe", "T1059.006", "high", "command", r"\|\s*python[0-9.]*\b"),
    ("exec-scripting-interpreter", "T1059", "medium", "segment", r"^(perl|ruby|php|node|lua)\s"),
    ("exec-reverse-shell", "T1059.004", "high", "command", r"/dev/(tcp|udp)/|\bnc\b.*\s-\w*e\b|mkfifo\b.*\bnc\b|socat\b.*exec:"),
    ("c2-raw-socket-tool", "T1095", "medium", "segment", r"^(nc|ncat|netcat|socat|telnet)\s"),
    ("c2-tunnel", "T1572", "high", "segment", r"^ssh\b.*\s-\w*[LRDw]\b|^(ngrok|chisel|frpc|cloudflared|autossh)\b"),
    ("c2-proxy", "T1090", "medium", "segment", r"^(3proxy|squid|tinyproxy|dante|danted|sockd|proxychains\S*|tor)(\s|$)"),
    ("c2-remote-access-tool", "T1219", "high", "command", r"\b(anydesk|teamviewer|rustdesk|meshagent|screenconnect|ngrok|chisel|frpc|tmate)\b"),
    ("lateral-ssh", "T1021.004", "medium", "segment", r"^(sshpass\s.*\s)?ssh\s+(?!.*-\w*V\b)(-\S+\s+\S+\s+|-\S+\s+)*[A-Za-z0-9_.-]+(@|\.)\S+|^(scp|rsync)\s+(-\S+\s+)*[^\s@:]+\s+\S+@\S+:"),
    ("exec-decode-payload", "T1140", "high", "command", r"base64\s+(-\w*d|--decode)|openssl\s+(enc|base64)\s.*-d\b|xxd\s+-r"),
    ("obfuscation-hex-escapes", "T1027", "medium", "command", r"(\\x[0-9a-fA-F]{2}){4,}|(\\[0-7]{3}){4,}"),
    ("impact-cryptomining", "T1496.001", "high", "segment", r"^(\S*/)?(xmrig|minerd|cpuminer|ccminer|xmr-stak|t-rex|nbminer)\b|stratum\+(tcp|ssl)://|\bminexmr\b|^(wget|curl)\s.*\b(xmrig|minerd|kinsing|kdevtmpfsi)\b"),
    ("evasion-clear-history", "T1070.003", "high", "command", r"history\s+-\w*c|(rm|>|truncate|shred|ln\s+-\S+\s+/dev/null)\s*.*\.(bash|zsh|ash|sh)_history"),
    ("evasion-prevent-history", "T1690", "high", "command", r"unset\s+HISTFILE|HISTFILE=/dev/null|HISTSIZE=0|set\s+\+o\s+history"),
    ("evasion-clear-logs", "T1685.006", "high", "command", r"(rm|truncate|shred|>|cat\s+/dev/null\s*>)\s*(-\S+\s+)*(\S+\s+)*/var/log/|journalctl\s.*--vacuum"),
    ("evasion-delete-files", "T1070.004", "medium", "segment", r"^(rm|unlink|shred)\s+(-\S+\s+)*([^\s/-]\S*|/[^\s*])"),
    ("evasion-timestomp", "T1070.006", "high", "segment", r"^touch\s+.*(-\w*[rtd]\b|--date|--reference)"),
    ("evasion-hidden-staging", "T1564.001", "medium", "command", r"(\b(mkdir|cd|cp|mv)\s|>|\s-[oOP]\s)\s*(-\S+\s+)*\S*/(tmp|var/tmp|dev/shm)/\.\w"),
    ("defense-impair-firewall", "T1686", "high", "segment", r"^(iptables|ip6tables|nft)\s+.*(-F|-X|flush|-P\s+\S+\s+ACCEPT)|^ufw\s+disable|(stop|disable)\s+(firewalld|ufw|iptables)|^service\s+(iptables|firewalld)\s+stop"),
    ("defense-impair-tools", "T1685", "high", "segment", r"^setenforce\s+0|(stop|disable|remove|purge)\b.*(apparmor|selinux|clamav|falco|fail2ban|aliyun|aegis|rsyslog)|^service\s+(rsyslog|apparmor|clamav\S*|falco|fail2ban)\s+stop|^(pkill|killall|kill)\s.*(aliyun|aegis|falco|clamav)"),
    ("defense-impair-audit", "T1685.004", "high", "segment", r"^auditctl\s+-(e\s*0|D)|(stop|disable)\s+auditd|^service\s+auditd\s+stop"),
    ("impact-service-stop", "T1489", "medium", "segment", r"^(systemctl|service)\s+.*\b(stop|disable|mask)\b|^(kill|killall|pkill)\s"),
    ("impact-shutdown", "T1529", "high", "segment", r"^(shutdown|reboot|poweroff|halt|init\s+[06])(\s|$)|^systemctl\s+(poweroff|reboot|halt)\b"),
    ("impact-destroy-data", "T1485", "high", "command", r"rm\s+-\w*r\w*\s+(--no-preserve-root\s+)?/(\s|\*|$)|dd\s+if=/dev/(zero|urandom)\s+of=/dev/|mkfs\."),
    ("impact-account-removal", "T1531", "medium", "segment", r"^(userdel|deluser|passwd\s+-[ld]|usermod\s+-L)\b"),
    ("collection-archive", "T1560.001", "medium", "segment", r"^(tar\s+-?\w*c|zip\s|gzip\s|7z\s+a|rar\s+a)"),
    ("exfil-upload", "T1048", "medium", "segment", r"^curl\b.*\s(-T|-F|--upload-file|--data-binary\s+@)|^(scp|rsync)\s+\S+\s+\S+@\S+:|^ftpput\b"),
    ("credential-search", "T1552.001", "medium", "segment", r"^grep\s+(-\S+\s+)*-\w*[rR]\w*\s.*(passw|secret|api_?key|token)"),
]

# Techniques with name and tactics.
CATALOG: list[tuple[str, str, str]] = [
    ("T1003.008", "/etc/passwd and /etc/shadow", "credential-access"), ("T1005", "Data from Local System", "collection"),
    ("T1007", "System Service Discovery", "discovery"), ("T1016", "System Network Configuration Discovery", "discovery"),
    ("T1016.001", "Internet Connection Discovery", "discovery"), ("T1018", "Remote System Discovery", "discovery"),
    ("T1021.004", "SSH", "lateral-movement"), ("T1027", "Obfuscated Files or Information", "stealth"),
    ("T1033", "System Owner/User Discovery", "discovery"), ("T1037.004", "RC Scripts", "persistence,privilege-escalation"),
    ("T1046", "Network Service Discovery", "discovery"), ("T1048", "Exfiltration Over Alternative Protocol", "exfiltration"),
    ("T1049", "System Network Connections Discovery", "discovery"), ("T1053.003", "Cron", "execution,persistence,privilege-escalation"),
    ("T1057", "Process Discovery", "discovery"), ("T1059", "Command and Scripting Interpreter", "execution"),
    ("T1059.004", "Unix Shell", "execution"), ("T1059.006", "Python", "execution"),
    ("T1069.001", "Local Groups", "discovery"), ("T1070.003", "Clear Command History", "stealth"),
    ("T1070.004", "File Deletion", "stealth"), ("T1070.006", "Timestomp", "stealth"), ("T1078", "Valid Accounts", "initial-access,persistence,privilege-escalation,stealth"),
    ("T1078.001", "Default Accounts", "initial-access,persistence,privilege-escalation,stealth"), ("T1082", "System Information Discovery", "discovery"),
    ("T1083", "File and Directory Discovery", "discovery"), ("T1087.001", "Local Account", "discovery"),
    ("T1090", "Proxy", "command-and-control"), ("T1095", "Non-Application Layer Protocol", "command-and-control"),
    ("T1098", "Account Manipulation", "persistence,privilege-escalation"), ("T1098.004", "SSH Authorized Keys", "persistence,privilege-escalation"),
    ("T1105", "Ingress Tool Transfer", "command-and-control"), ("T1110", "Brute Force", "credential-access"),
    ("T1110.001", "Password Guessing", "credential-access"), ("T1124", "System Time Discovery", "discovery"),
    ("T1136.001", "Local Account", "persistence"), ("T1140", "Deobfuscate/Decode Files or Information", "stealth"),
    ("T1201", "Password Policy Discovery", "discovery"), ("T1219", "Remote Access Tools", "command-and-control"),
    ("T1222.002", "Linux and Mac File and Directory Permissions Modification", "defense-impairment"), ("T1485", "Data Destruction", "impact"),
    ("T1489", "Service Stop", "impact"), ("T1496.001", "Compute Hijacking", "impact"), ("T1497", "Virtualization/Sandbox Evasion", "stealth,discovery"),
    ("T1518", "Software Discovery", "discovery"), ("T1529", "System Shutdown/Reboot", "impact"), ("T1531", "Account Access Removal", "impact"),
    ("T1543.002", "Systemd Service", "persistence,privilege-escalation"), ("T1546.004", "Unix Shell Configuration Modification", "persistence,privilege-escalation"),
    ("T1548.001", "Setuid and Setgid", "privilege-escalation"), ("T1548.003", "Sudo and Sudo Caching", "privilege-escalation"),
    ("T1552.001", "Credentials In Files", "credential-access"), ("T1552.003", "Shell History", "credential-access"),
    ("T1552.004", "Private Keys", "credential-access"), ("T1560.001", "Archive via Utility", "collection"), ("T1564.001", "Hidden Files and Directories", "stealth"),
    ("T1572", "Protocol Tunneling", "command-and-control"), ("T1574.006", "Dynamic Linker Hijacking", "persistence,privilege-escalation,stealth"),
    ("T1654", "Log Enumeration", "discovery"), ("T1685", "Disable or Modify Tools", "defense-impairment"), ("T1685.004", "Disable or Modify Audit System", "defense-impairment"),
    ("T1685.006", "Clear Logs", "defense-impairment"), ("T1686", "Disable or Modify Firewall", "defense-impairment"), ("T1690", "Impair Command History Logging", "defense-impairment"),
]

# Reading order of tactics, and those of a session that took action.
TACTIC_ORDER = [
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "stealth",
    "defense-impairment", "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact",
]
ACTION_TACTICS = [
    "persistence", "privilege-escalation", "credential-access", "command-and-control", "lateral-movement", "collection",
    "exfiltration", "impact", "defense-impairment",
]
CONFIDENCES, SCOPES = ["low", "medium", "high"], ["segment", "command"]


def catalog(spark: SparkSession) -> DataFrame:
    """(technique, name, tactics): small by nature, so it may be broadcast."""
    return spark.createDataFrame(CATALOG, "technique string, name string, tactics string")


def rule_table(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "rule string, technique string, confidence string, scope string, pattern string")


def _compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether Spark's regular expressions, which are Java's, take the pattern."""
    try:
        spark._jvm.java.util.regex.Pattern.compile("(?Ud)" + pattern)
    except IllegalArgumentException:
        return False
    return True


def rule_problems(rules: DataFrame, techniques: DataFrame) -> DataFrame:
    """(rule, problem): missing fields, unknown techniques, confidences or scopes, patterns that don't compile, repeated ids."""
    blank = F.exists(F.array("rule", "technique", "confidence", "scope", "pattern"), lambda x: F.coalesce(F.trim(x) == "", F.lit(True)))
    checks = F.array_compact(F.array(
        F.when(blank, "a field is missing"), F.when(~F.col("confidence").isin(CONFIDENCES), "unknown confidence"), F.when(~F.col("scope").isin(SCOPES), "unknown scope"),
        F.when(F.col("_known").isNull(), "unknown technique"), F.when(F.col("_n") > 1, "the id is repeated"),
    ))
    known = techniques.select(F.col("technique").alias("_t"), F.lit(1).alias("_known"))
    often = rules.groupBy(F.col("rule").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    joined = rules.join(F.broadcast(known), F.col("technique") == F.col("_t"), "left").join(F.broadcast(often), F.col("rule").eqNullSafe(F.col("_r")))
    spark = rules.sparkSession
    # a rule file is read by people: some hundred lines
    bad = [(r.rule, "the pattern does not compile") for r in rules.where("pattern is not null").select("rule", "pattern").collect() if not _compiles(spark, r.pattern)]
    return joined.select("rule", F.explode(checks).alias("problem")).unionByName(spark.createDataFrame(bad, "rule string, problem string"))


def rules_version(rules: DataFrame) -> str:
    """A hash of the rules' content, whatever their order."""
    row = rules.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.to_json(F.struct("*")))), "\n"), 256)).first()
    return row[0][:16]
