"""Provider-shaped records written for the tests, with the verdicts they must get."""

TRAIL = [
    dict(eventID="t1", eventTime="2024-11-16T10:30:15Z", eventName="ConsoleLogin", sourceIPAddress="203.0.113.45",
         userIdentity=dict(type="IAMUser", principalId="P1", userName="ann"), requestParameters=None,
         responseElements=dict(ConsoleLogin="Success"), recipientAccountId="111122223333"),
    dict(eventID="t2", eventTime="2024-11-16T03:15:22Z", eventName="CreateAccessKey", sourceIPAddress="198.51.100.42",
         userIdentity=dict(type="Root", principalId="111122223333"), requestParameters=dict(userName="eve"),
         recipientAccountId="111122223333"),
    dict(eventID="t3", eventTime="2024-11-16T11:00:00Z", eventName="AttachUserPolicy",
         userIdentity=dict(type="AssumedRole", principalId="P3", sessionContext=dict(sessionIssuer=dict(userName="issuer"))),
         recipientAccountId="111122223333"),
    dict(eventID="t4", eventTime="2024-11-16T14:00:00Z", eventName="AuthorizeSecurityGroupIngress",
         userIdentity=dict(type="IAMUser", principalId="P4", userName="dan")),
    dict(eventID="t5", eventTime="2024-11-16T15:00:00Z", eventName="ConsoleLogin", errorCode="Failed", errorMessage="no",
         userIdentity=dict(type="IAMUser", principalId="P5", userName="ann")),
    dict(eventID="t6", eventTime="2024-11-16T12:00:00Z", eventName="GetObject", userIdentity=dict(type="IAMUser", userName="bob"),
         resources=[dict(ARN="arn:aws:s3:::b", accountId="1", type="AWS::S3::Object"), dict(ARN="arn:second")]),
    dict(eventID="t7", eventTime="2024-11-16T13:00:00Z", eventName="TerminateInstances", userIdentity=dict(type="IAMUser", userName="bob")),
    dict(eventID="t8", eventTime="2024-11-13T21:00:00Z", eventName="StartLogging", userIdentity=dict(type="IAMUser", userName="bob")),
]


def finding(name, severity, kind, action="NETWORK_CONNECTION"):
    return dict(
        id=name, type=kind, severity=severity, title="t", description="d", updatedAt="2024-11-16T12:30:00.000Z",
        service=dict(action=dict(actionType=action, networkConnectionAction=dict(
            remoteIpDetails=dict(ipAddressV4="185.220.101.42"), localPortDetails=dict(port=22), protocol="TCP"))))


FINDINGS = [finding("g1", 8, "UnauthorizedAccess:EC2/Brute"), finding("g2", 9.5, "Crypto:EC2/Miner"),
            finding("g3", 8.0, "Recon:IAM/Probe", "AWS_API_CALL")]


def activity(name, time, operation, status="Succeeded", level="Informational"):
    return dict(
        eventDataId=name, caller="ops@example.com", level=level, eventTimestamp=time, resourceGroupName="rg", correlationId="c",
        operationName=dict(value=operation, localizedValue="x"), status=dict(value=status, localizedValue=status),
        category=dict(value="Administrative"), eventName=dict(value="EndRequest"), resourceId="/subscriptions/1/vm")


ACTIVITY = [
    activity("z1", "2024-11-16T10:15:30.1234567Z", "Microsoft.Compute/virtualMachines/write"),
    activity("z2", "2024-11-16T03:22:15.5678901Z", "Microsoft.Network/securityRules/write", level="Warning"),
    activity("z3", "2024-11-16T12:00:00.0000000Z", "Microsoft.Storage/accounts/delete", "Failed", "Error"),
    activity("z5", "2024-11-18T20:00:00.0000000Z", "Microsoft.Compute/virtualMachines/write"),
]


def audit(name, time, method, severity="NOTICE"):
    return dict(
        insertId=name, timestamp=time, severity=severity, logName="projects/p/logs/cloudaudit.googleapis.com%2Factivity",
        resource=dict(type="gce_instance", labels=dict(zone="z")),
        protoPayload=dict(methodName=method, resourceName="projects/p/x", authenticationInfo=dict(principalEmail="a@example.com"),
                          requestMetadata=dict(callerIp="203.0.113.9"), request=dict(name="n")))


AUDIT = [
    audit("p1", "2024-11-16T10:30:00.123456Z", "v1.compute.instances.insert"),
    audit("p2", "2024-11-16T03:00:00Z", "google.iam.admin.v1.CreateServiceAccountKey", "WARNING"),
    audit("p4", "2024-11-16T11:00:00Z", "storage.buckets.delete"),
    audit("p5", "2024-11-16T11:00:00Z", "storage.objects.get"),
]

# event id: (event type, matched rule ordinals, alert severity by rules only, heuristic score)
VERDICTS = {
    "t1": ("authentication", [], None, 0.3), "t2": ("configuration_change", [1, 4, 9], "critical", 0.7),
    "t3": ("authorization", [4], "critical", 0.3), "t4": ("authorization", [5], "high", 0.3),
    "t5": ("authentication", [2], "high", 0.3), "t6": ("resource_access", [], None, 0.3),
    "t7": ("unknown", [], None, 0.7), "t8": ("unknown", [], None, 0.0),
    "g1": ("security_alert", [10], "critical", 0.3), "g2": ("security_alert", [10], "critical", 0.3),
    "g3": ("security_alert", [10], "critical", 0.3),
    "z1": ("administrative_action", [], None, 0.3), "z2": ("administrative_action", [], None, 0.6),
    "z3": ("administrative_action", [], None, 0.7), "z5": ("administrative_action", [], None, 0.0),
    "p1": ("unknown", [], None, 0.3), "p2": ("configuration_change", [], None, 0.7),
    "p4": ("configuration_change", [], None, 0.7), "p5": ("resource_access", [], None, 0.3),
}
